"""Training-data pipeline operators: one module per operator, queries and SQL beside them.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it
is present.
"""
