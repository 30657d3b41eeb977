"""Data operators for operational records, written as Spark DataFrame transformations."""
