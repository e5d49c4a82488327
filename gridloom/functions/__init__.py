"""Column functions: keys, hashes, projections, geometry, pixels, contracts."""
