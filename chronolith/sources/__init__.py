"""Time-clustered layouts: in memory, on disk, and the registry that names them."""
