"""Whole requests: configuration to model."""
