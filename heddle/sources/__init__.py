"""Storage: sorted runs in Parquet with their manifest, and the key-value facade over them."""
