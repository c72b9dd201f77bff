"""Column-expression functions (native Spark expressions only)."""
