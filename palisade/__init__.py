"""Analytics for code-change security data on PySpark."""
