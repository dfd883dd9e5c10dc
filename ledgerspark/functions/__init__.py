"""Column expressions and row-wise projections."""
