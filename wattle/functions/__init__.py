"""Column builders: pure ``Column -> Column`` expressions over Spark built-ins."""
