"""Knowledge-assembly analytics on Spark."""
