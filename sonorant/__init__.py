"""Speech-evaluation analytics as Spark DataFrame operators."""
