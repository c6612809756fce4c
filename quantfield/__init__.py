"""Error-bounded analytics of numeric fields, as Spark DataFrame operators."""
