"""Document and sheet analytics on Spark."""
