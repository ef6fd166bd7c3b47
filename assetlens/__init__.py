"""Asset usage analytics as Spark DataFrame operators."""
