"""Season labels, calendar phases, trade deadline distance."""

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season_label(start) -> Column:
    """``2024`` -> ``2024-25``."""
    s = _c(start)
    return F.format_string("%d-%02d", s.cast("int"), ((s + 1) % 100).cast("int"))


def parse_season(text) -> Column:
    """End year of ``2024-25``, ``20242025``, ``202425`` or ``2025``; anything else is NULL."""
    t = F.trim(_c(text))
    digits = F.regexp_replace(t, "[^0-9]", "")
    start = F.substring(digits, 1, 4).try_cast("int")
    tail = F.substring(digits, 5, 4).try_cast("int")
    century = F.floor(start / 100) * 100 + tail
    short = F.when(century <= start, century + 100).otherwise(century)
    return (F.when(F.length(digits) == 8, tail).when(F.length(digits) == 6, short)
            .when(F.length(digits) == 4, digits.try_cast("int")))


def season_of(day, first_month: int = 7) -> Column:
    d = _c(day)
    return F.year(d) - F.when(F.month(d) >= first_month, 0).otherwise(1)


def season_state(day, league: str) -> Column:
    """offseason / preseason / regular / playoffs by calendar."""
    d = _c(day)
    m, md = F.month(d), F.month(d) * 100 + F.dayofmonth(d)
    # Calendar limits per league, as month*100+day.
    if league == "nhl":
        rules = [((md >= 701) & (md < 915), "offseason"), (m == 9, "preseason"), (m.isin(5, 6), "playoffs")]
    elif league == "nba":
        rules = [((md >= 701) & (md < 920), "offseason"), ((md >= 920) & (md < 1015), "preseason"), (m.isin(5, 6), "playoffs")]
    elif league == "mlb":
        rules = [(m.isin(11, 12, 1, 2), "offseason"), ((md >= 301) & (md < 320), "preseason"), (m == 10, "playoffs")]
    else:
        rules = [((md >= 301) & (md < 805), "offseason"), (m == 8, "preseason"), (m.isin(1, 2), "playoffs")]
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise("regular")


def deadline_days(day, season_start) -> tuple[Column, Column]:
    """Days since the last and until the next January-1 deadline of the season that began in ``season_start``."""
    d, s = _c(day), _c(season_start)

    def jan1(year):
        return F.make_date(year, F.lit(1), F.lit(1))

    passed = d >= jan1(s + 1)
    since = F.datediff(d, F.when(passed, jan1(s + 1)).otherwise(jan1(s)))
    until = F.datediff(F.when(passed, jan1(s + 2)).otherwise(jan1(s + 1)), d)
    return F.greatest(F.lit(0), since), F.greatest(F.lit(0), until)
