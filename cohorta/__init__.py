"""Student-outcome analytics written as PySpark DataFrame operators."""
