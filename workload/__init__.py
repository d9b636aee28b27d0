"""The registered queries: views over the given tables, and per operator a Spark query with the same result in SQL."""
