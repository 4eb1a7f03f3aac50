"""Temperature regime features used by the load regression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three temperature breakpoints of the regression (degrees C).
COOLING_ABOVE = 20.0   # cooling term  max(t - 20, 0)
HEATING_BELOW = 16.0   # heating term  max(16 - t, 0)
COLD_BELOW = 5.0       # cold term     max(5 - t, 0)


def temperature_terms(t: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    return (
        F.greatest(t - F.lit(COOLING_ABOVE), zero),
        F.greatest(F.lit(HEATING_BELOW) - t, zero),
        F.greatest(F.lit(COLD_BELOW) - t, zero),
    )
