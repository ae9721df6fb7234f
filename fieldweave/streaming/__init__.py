"""The operators that work on unbounded observation streams."""
