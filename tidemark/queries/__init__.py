"""Query registry modules; each has QUERIES and SQL dictionaries."""
