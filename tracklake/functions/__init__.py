"""Column functions over bytes, ids and sampled values."""
