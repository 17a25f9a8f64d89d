"""Entity resolution and lead analytics as Spark DataFrame operators."""
