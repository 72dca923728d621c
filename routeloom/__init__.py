"""Address, point-of-interest and route analytics on Spark."""
