"""Photo-library analytics on Spark: catalog queries, rules, joins, windows and change logs as DataFrame operators."""
