"""Bridge views over the test tables, and the query catalogue with its SQL statements."""
