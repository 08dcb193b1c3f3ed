"""Contact-centre quality analytics as plain Spark DataFrame code."""
