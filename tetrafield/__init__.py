"""tetrafield: sampling of layered 3-D property models, and training-data operators, as Spark plans."""
