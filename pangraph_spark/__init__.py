"""Graph-genome analytics as PySpark DataFrame plans."""
