"""Queries over the test tables, one module per group of operators, each with QUERIES and SQL."""
