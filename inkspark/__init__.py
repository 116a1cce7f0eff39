"""inkspark: recognition analytics for right-to-left printed script, on Spark."""
