"""Reading and writing tables and fitted models."""
