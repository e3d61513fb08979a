"""The same operators on streams of points."""
