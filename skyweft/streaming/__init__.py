"""Incremental counterparts of the file-by-file accumulation loops."""
