"""Writers: CSV, pass-through text catalogs, regions, SVG footprints, FITS."""
