"""Operators: each takes and returns DataFrames. `dst` is the vertex that receives, the row of a CSR matrix."""
