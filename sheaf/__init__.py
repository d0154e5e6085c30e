"""Pattern-and-action record analytics on Spark."""
