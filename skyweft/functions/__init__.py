"""Column expressions: sky geometry, photometry, text, star stamps, kernels."""
