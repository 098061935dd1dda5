"""Moon phase of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A new moon's day number, the length of a lunation, and the names of its eighths.
NEW_MOON, LUNATION = 2451550.1, 29.530588853
NAMES = ["new", "waxing crescent", "first quarter", "waxing gibbous", "full", "waning gibbous", "last quarter", "waning crescent"]


def day_number(ts: Column) -> Column:
    """The Julian day of a civil date: days since 1970-01-01, which is day 2440588."""
    return F.unix_date(F.to_date(ts)) + F.lit(2440588)


def moon(ts: Column) -> Column:
    """phase (0 to 1), name, illumination (per cent), and the selection weights alpha and beta."""
    turns = (day_number(ts) - F.lit(NEW_MOON)) / F.lit(LUNATION)
    phase = turns - F.floor(turns)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.floor(phase * 8) % 8 + 1).cast("int"))
    lit = F.abs(F.cos(phase * F.lit(2 * 3.141592653589793))) * 100
    return F.struct(phase.alias("phase"), name.alias("name"), lit.alias("illumination"), F.round(0.8 + 0.4 * phase, 4).alias("alpha"), F.round(0.3 + 0.4 * lit / 100, 4).alias("beta"))
