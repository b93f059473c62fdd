"""DataFrame operators over write logs, replicas, registers, sets, ordered keys and cluster states."""
