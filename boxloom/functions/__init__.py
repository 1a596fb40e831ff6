"""Column expressions: boxes, geometry, names, digests, labels."""
