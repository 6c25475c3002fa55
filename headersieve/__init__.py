"""Bot recognition from HTTP request headers, on Spark."""
