"""Linear algebra on Spark: a matrix is a relation ``(i, j, v)``, a vector is a relation ``(i, v)``."""
