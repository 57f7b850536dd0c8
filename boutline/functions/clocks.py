"""Game clocks, periods, field position."""

from pyspark.sql import Column, functions as F

# Fixed values: (periods, minutes per period, clock counts up) per clock sport, and regulation innings.
REGULATION = {"nba": (4, 12.0, False), "nfl": (4, 15.0, False), "nhl": (3, 20.0, True)}
INNINGS = 9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clock_seconds(c) -> Column:
    """Seconds of ``mm:ss`` (or plain number) text; malformed is NULL."""
    t = F.trim(_c(c))
    parts = F.split(t, ":")
    timed = F.try_element_at(parts, F.lit(1)).try_cast("double") * 60.0 + F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(t.contains(":"), timed).otherwise(t.try_cast("double"))


def minutes_decimal(c) -> Column:
    return clock_seconds(c) / 60.0


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def frac_remaining_clock(league: str, period, clock) -> Column:
    """Share of regulation left; overtime is 0, an unusable clock counts whole periods."""
    periods, minutes, up = REGULATION[league]
    length = minutes * 60.0
    period, clock = _c(period), _c(clock)
    done = F.greatest(F.lit(0), period - 1) * length
    inside = clock if up else length - clock
    inside = F.greatest(F.lit(0.0), F.least(F.lit(length), inside))
    elapsed = done + F.coalesce(F.when(clock.isNotNull(), inside), F.lit(0.0))
    return F.when(period > periods, 0.0).otherwise(_unit(1.0 - elapsed / (periods * length)))


def frac_remaining_innings(inning, is_top) -> Column:
    halves = (_c(inning) - 1) * 2 + F.when(_c(is_top), 0).otherwise(1)
    return _unit(1.0 - halves / (2.0 * INNINGS))


def period_label(league, period, half=None) -> Column:
    """Q1..Q4 then OT (football) or OTn (basketball); T/B/M/E plus inning for baseball."""
    lg, p = _c(league), _c(period)
    q = F.concat(F.lit("Q"), p.cast("string"))
    out = (F.when(p.isNull(), F.lit(None).cast("string"))
           .when((lg == "nfl") & (p > 4), "OT")
           .when((lg == "nba") & (p > 4), F.concat(F.lit("OT"), (p - 4).cast("string")))
           .when(lg.isin("nfl", "nba"), q))
    if half is not None:
        first = F.upper(F.substring(F.trim(_c(half)), 1, 1))
        known = F.lower(_c(half)).rlike("^(top|bottom|middle|end)")
        out = out.when(known, F.concat(first, p.cast("string")))
    return out.otherwise(p.cast("string"))


def yards_to_endzone(yard_line, offense_is_home) -> Column:
    """Yards the offense needs, from a yard line in [0, 100]; unknown without possession."""
    yard = F.greatest(F.lit(0), F.least(F.lit(100), _c(yard_line)))
    own = _c(offense_is_home)
    return F.when(own.isNotNull() & yard.isNotNull(), F.when(own, 100 - yard).otherwise(yard))
