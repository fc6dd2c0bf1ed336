"""Login-attack analytics as PySpark DataFrame operators."""
