"""Analytics over configuration, change-sets and code facts, written for Spark's DataFrame API."""
