"""Daily-demand panel analytics as Spark DataFrame transformations."""
