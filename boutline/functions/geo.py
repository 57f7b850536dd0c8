"""Distance and time-zone columns."""

from pyspark.sql import Column, functions as F

EARTH_MILES = 3958.7613


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle miles; NULL when any coordinate is."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = F.sin((a2 - a1) / 2.0)
    half_lon = F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2.0)
    chord = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2.0 * EARTH_MILES)


def utc_offset_hours(tz, day) -> Column:
    """Offset of a zone from UTC at local noon of the day."""
    noon = F.to_timestamp(_c(day)) + F.expr("INTERVAL 12 HOURS")
    return (F.unix_timestamp(noon) - F.unix_timestamp(F.to_utc_timestamp(noon, _c(tz)))) / 3600.0


def local_date(ts, tz) -> Column:
    """Calendar date of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(_c(ts), _c(tz) if not isinstance(tz, str) else F.lit(tz)))


def start_utc(local, tz, neutral) -> Column:
    """UTC start from local time and home zone; unknown at a neutral site."""
    return F.when(~_c(neutral), F.to_utc_timestamp(_c(local), _c(tz)))
