"""Fixed value tables (``values``) and column expressions (``expressions``)."""
