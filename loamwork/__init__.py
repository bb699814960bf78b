"""Dataset preparation and quality work as PySpark DataFrame operators."""
