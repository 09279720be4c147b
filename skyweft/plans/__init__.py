"""Plan-level building blocks: lineage cuts, skew handling, halo tiles, ranks."""
