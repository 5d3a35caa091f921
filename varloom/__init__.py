"""varloom: market-risk analytics as Spark DataFrame plans."""
