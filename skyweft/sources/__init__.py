"""Readers: text catalogs, FITS files, CSV tables, listings, service payloads."""
