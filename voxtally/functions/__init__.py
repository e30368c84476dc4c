"""Column expressions; none of them adds a shuffle or a Python worker."""
