"""Scalar functions of the index: weights, cubes and the mappings of columns to the unit interval."""
