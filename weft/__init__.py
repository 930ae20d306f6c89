"""weft: evidence analytics as Spark DataFrame operators."""
