"""Analog search and read-across as Spark DataFrame transformations."""
