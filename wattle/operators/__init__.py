"""Operators: functions ``DataFrame -> DataFrame`` composed from Spark built-ins."""
