"""Ready-made diagnostics, and the queries of the entry module."""
