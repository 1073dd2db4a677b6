"""Analytics over recognized document text, on Spark."""
