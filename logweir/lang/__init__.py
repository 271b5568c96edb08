"""The query language: text to an expression tree, without Spark."""
