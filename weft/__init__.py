"""weft: graph patterns and sparse linear algebra as lazy Spark plans."""
