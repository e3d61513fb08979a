"""Relational operators over points, meshes, rasters and coastlines."""
