"""Contest status, phase and situation columns."""

from pyspark.sql import Column, functions as F

# Status type names of contests that will not be played as scheduled.
POSTPONED_NAMES = ["STATUS_POSTPONED", "STATUS_CANCELED", "STATUS_SUSPENDED", "STATUS_DELAYED", "STATUS_RAIN_DELAY"]

# Notes on contests that need care.
NOTES = {"unplayed": "unplayed_or_missing_score", "tie": "tie_excluded_from_binary_home_win", "unknown": "unknown_team_alias",
         "preseason": "preseason_flagged_exclude_from_training"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_from_state(state, type_name) -> Column:
    """Scoreboard state (pre/in/post) and type name to a shared status."""
    s = F.lower(_c(state))
    return (F.when(_c(type_name).isin(POSTPONED_NAMES), "postponed")
            .when(s == "in", "live").when(s == "post", "final").otherwise("scheduled"))


def status_from_detail(abstract, detailed) -> Column:
    """Baseball states: a delay is postponed, a warm-up is not live."""
    a, d = F.lower(F.coalesce(_c(abstract), F.lit(""))), F.lower(F.coalesce(_c(detailed), F.lit("")))
    return (F.when(d.rlike("postpon|suspend|delay"), "postponed")
            .when((a == "final") | d.isin("final", "game over"), "final")
            .when((a == "live") & d.rlike("warmup|pre-game|pregame"), "scheduled")
            .when(a == "live", "live").otherwise("scheduled"))


def status_from_text(text, played) -> Column:
    """Free status text; without one a played contest is final."""
    t = F.lower(F.trim(F.coalesce(_c(text), F.lit(""))))
    return (F.when(t.rlike("postpon|cancelled|canceled|suspended"), "postponed")
            .when(t.rlike("in progress|in-progress|live|halftime"), "live")
            .when(_c(played), "final").otherwise("scheduled"))


def status_from_codes(game_state, schedule_state) -> Column:
    """Hockey state codes."""
    codes = F.array(F.upper(F.coalesce(_c(game_state), F.lit(""))), F.upper(F.coalesce(_c(schedule_state), F.lit(""))))

    def any_of(*names):
        return F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))

    return (F.when(any_of("PPD", "POSTPONED"), "postponed").when(any_of("LIVE", "CRIT"), "live")
            .when(any_of("OFF", "FINAL"), "final").otherwise("scheduled"))


def played_score(score, status) -> Column:
    """Scores exist only for live and final contests."""
    return F.when(_c(status).isin("live", "final"), _c(score))


def classify(game_type, home_score, away_score, known) -> dict[str, Column]:
    """Phase, played/tie flags, label and quality notes of a contest."""
    gt, hs, as_ = _c(game_type), _c(home_score), _c(away_score)
    phase = F.when(gt.isin("PRE", "REG"), gt).otherwise("POST")
    has = hs.isNotNull() & as_.isNotNull()
    tie = has & (hs == as_)
    tie = F.coalesce(tie, F.lit(False))
    return {
        "phase": phase, "played": has.cast("int"), "unplayed": (~has).cast("int"), "tie": tie.cast("int"),
        "home_win": F.when(has & ~tie, (hs > as_).cast("int")),
        "notes": F.nullif(F.concat_ws(";", *[F.when(when, F.lit(NOTES[kind])) for kind, when in (
            ("unplayed", ~has), ("tie", tie), ("unknown", ~_c(known)), ("preseason", phase == "PRE"))]), F.lit(""))}


def situation_flags(rest, roof, temp, wind, hour, weekday) -> dict[str, Column]:
    rest, roof, temp, wind = _c(rest), F.lower(_c(roof)), _c(temp), _c(wind)
    return {
        "short_week": (rest <= 4).cast("int"), "post_bye": (rest >= 10).cast("int"),
        "dome": roof.isin("dome", "closed").cast("int"),
        "bad_weather": F.coalesce(roof.isin("outdoors", "open") & ((temp <= 35) | (wind >= 15)), F.lit(False)).cast("int"),
        "primetime": _c(hour).isin(20, 21).cast("int"), "thursday": (F.lower(_c(weekday)) == "thursday").cast("int")}


def signed_streak(code, n) -> Column:
    c, n = _c(code), _c(n)
    return F.when(c.isNotNull() & n.isNotNull(), F.when(F.upper(c).startswith("W"), n).otherwise(-n))
