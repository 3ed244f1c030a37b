"""Building-energy analytics as Spark DataFrame transformations."""
