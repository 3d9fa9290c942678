"""The allow-listed functions as Spark column expressions."""
