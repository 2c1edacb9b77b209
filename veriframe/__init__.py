"""DataFrame operators for the data processing behind staged code-correctness analysis."""
