"""Decimal catalogue: precision and scale per kind of measure."""

from __future__ import annotations

from pyspark.sql import types as T

# numeric(p, s) of the published tables.
PRICE = T.DecimalType(20, 6)
RATIO = T.DecimalType(14, 6)
QUANTITY = T.DecimalType(24, 4)
FACTOR = T.DecimalType(24, 8)
INDICATOR = T.DecimalType(20, 8)
SCORE = T.DecimalType(24, 6)
WEIGHT = T.DecimalType(14, 8)
NAV = T.DecimalType(20, 8)
EXACT = T.DecimalType(30, 10)  # unrounded source value, for comparing repeated reports

# Tolerances and gate bounds.
PRICE_TOLERANCE = "0.001"
PCT_TOLERANCE = "0.01"
GATE_MAX_COUNT = 20
GATE_MAX_RATIO = "0.01"
LAG_MIN_ROWS = 20
LAG_MIN_RATIO = "0.95"
MONEY_MERGE_ABS, RATE_MERGE_ABS, MERGE_REL = "500", "0.01", "0.001"
