"""Column functions: version vectors, consistency levels, registers, checksums."""
