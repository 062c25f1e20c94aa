"""Point-in-time valuation analytics expressed as Spark DataFrame operators."""
