"""The factor expression language."""
