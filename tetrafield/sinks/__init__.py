"""Writers and their registry."""
