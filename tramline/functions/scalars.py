"""Column builders: local time, distances and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def local(utc_seconds: Column, zone: str = ZONE) -> Column:
    """Wall-clock timestamp without a zone of UTC seconds; does not depend on the session's zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), utc_seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def service_day(wall: Column) -> Column:
    """The day a wall-clock time belongs to: days begin at four in the morning."""
    return F.to_date(wall - F.expr("INTERVAL '4' HOUR"))


def hour_of_week(wall: Column) -> Column:
    return F.weekday(wall) * 24 + F.hour(wall)


def daypart(wall: Column, bounds: tuple[int, ...] = (6, 10, 15, 19), weekend: bool = True) -> Column:
    """0 night, 1 morning, 2 midday, 3 afternoon, 4 evening; five more at weekends."""
    part = sum((F.when(F.hour(wall) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return part + F.when(F.weekday(wall) >= 5, 5).otherwise(0) if weekend else part


def metres(lat: Column, lon: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def allowed_error(lead: Column) -> Column:
    """Seconds a forecast may be off: 180 from half an hour ahead, 120 from twenty minutes, else 60."""
    return F.when(lead >= 1800, 180).when(lead >= 1200, 120).otherwise(60)
