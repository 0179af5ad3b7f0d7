"""Panel and territory analytics expressed as Spark DataFrame operators."""
