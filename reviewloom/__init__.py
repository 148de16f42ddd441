"""Review-abuse graph analytics on Spark."""
