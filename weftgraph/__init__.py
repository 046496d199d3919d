"""Property-graph analytics over source files and tables, written as Spark plans."""
