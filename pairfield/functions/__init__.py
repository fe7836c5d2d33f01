"""Column functions: metric, bins, Legendre polynomials and the sky."""
