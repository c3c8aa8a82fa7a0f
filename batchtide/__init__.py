"""Event replay, auction and market analytics on Spark."""
