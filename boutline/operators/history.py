"""Pregame history features built on the timeline operators."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.operators.joins import attach_row
from boutline.operators.timeline import (first_of_day, mean_of, run_count, run_max, run_sum, signed_run, with_running,
                                         with_trailing)

DAY, TIE = "game_date", ["game_id"]


def form_features(log: DataFrame) -> DataFrame:
    """Season form before each contest (decided contests only): rates, last-10, streak, stands, density.

    Season form resets every season; a win is worth two points and nothing else scores.
    """
    keys = ["entity", "season"]
    won, home = F.col("win") == 1, F.col("is_home") == 1
    rows = with_running(
        log.filter("win is not null"), keys, DAY, TIE,
        running={"games": run_count("win"), "wins": run_sum("win"), "gd": run_sum("diff"),
                 "home_games": run_sum("is_home"), "home_wins": run_sum(F.when(home, F.col("win")).otherwise(0)),
                 "prev_date": run_max(DAY)})
    rows = with_trailing(rows, keys, {
        "last10_pct": (10, mean_of("win")), "last10_gd": (10, mean_of("diff")),
        "last5_pct": (5, mean_of("win")), "last3_gd": (3, mean_of("diff"))})
    away_games = F.col("games") - F.col("home_games")
    away_wins = F.col("wins") - F.col("home_wins")
    return rows.withColumns({
        "season_pct": F.try_divide("wins", "games"), "season_gd": F.try_divide("gd", "games"),
        "home_pct": F.try_divide("home_wins", "home_games"), "away_pct": F.try_divide(away_wins, away_games)})


def runs(log: DataFrame, keys: Sequence[str] = ("entity", "season")) -> DataFrame:
    """Signed streak, home-stand and road-trip lengths entering each contest."""
    keys = list(keys)
    rows = with_running(log, keys, DAY, TIE)
    won, home = F.col("win") == 1, F.col("is_home") == 1
    rows = with_running(rows, keys, DAY, TIE, running={
        "last_win": run_max(F.when(won, F.col("seq"))), "last_loss": run_max(F.when(~won, F.col("seq"))),
        "last_home": run_max(F.when(home, F.col("seq"))), "last_away": run_max(F.when(~home, F.col("seq")))})
    stand = signed_run(F.col("last_home"), F.col("last_away"))
    return rows.withColumns({
        "streak": signed_run(F.col("last_win"), F.col("last_loss")),
        "home_stand": F.when(home, F.greatest(stand, F.lit(0)) + 1).otherwise(0),
        "road_trip": F.when(home, 0).otherwise(F.greatest(-stand, F.lit(0)) + 1)})


def day_counts(log: DataFrame, keys: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Contests of the key in the last 1..n days, per (key, day)."""
    daily = log.groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date(DAY))
    return daily.select(*keys, DAY, *[
        F.coalesce(F.sum("__n").over(w.rangeBetween(-n, -1)), F.lit(0)).alias(f"games_{n}d") for n in spans])


def pivot_sides(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Bring the two entity rows of each contest back to one row: home_x, away_x and delta_x.

    One aggregation by contest; no self-join.
    """
    home, away = F.col("is_home") == 1, F.col("is_home") == 0
    aggs: list[Column] = [F.max(F.when(home, F.col("entity"))).alias("home"),
                          F.max(F.when(away, F.col("entity"))).alias("away")]
    for f in features:
        aggs += [F.max(F.when(home, F.col(f))).alias(f"home_{f}"), F.max(F.when(away, F.col(f))).alias(f"away_{f}")]
    return (rows.groupBy(*keep).agg(*aggs)
            .withColumns({f"delta_{f}": F.col(f"home_{f}") - F.col(f"away_{f}") for f in features}))


def density(log: DataFrame, keys: Sequence[str], max_rest: int | None = None) -> DataFrame:
    """Rest days, back-to-back, three-in-four and four-in-six.

    Without ``max_rest`` rest is the number of free days since the last contest (never negative)
    and a back-to-back has none; with it, rest is the day gap clipped to [0, max_rest] and a
    back-to-back is a gap of at most one day.
    """
    keys = list(keys)
    rows = with_running(log, keys, DAY, TIE, running={"prev_date": run_max(DAY)})
    rows = rows.join(day_counts(log, keys, [3, 5]), [*keys, DAY])
    gap = F.datediff(DAY, "prev_date")
    if max_rest is None:
        rest = F.greatest(gap - 1, F.lit(0))
        b2b = F.when(rest == 0, 1).otherwise(0)
    else:
        rest = F.greatest(F.lit(0), F.least(F.lit(max_rest), gap))
        b2b = F.when(rest.isNotNull(), (rest <= 1).cast("int"))
    return rows.withColumns({
        "rest_days": F.when(F.col("prev_date").isNotNull(), rest),
        "back_to_back": F.when(F.col("prev_date").isNotNull(), b2b).otherwise(0 if max_rest is None else None),
        "three_in_four": (F.col("games_3d") >= 2).cast("int"),
        "four_in_six": (F.col("games_5d") >= 3).cast("int")})


def travel(log: DataFrame, venues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Miles and zone shift from the previous venue; the venue is the home side's base."""
    from boutline.functions.geo import haversine, utc_offset_hours

    host = F.when(F.col("is_home") == 1, F.col("entity")).otherwise(F.col("opponent"))
    places = venues.select(F.col("entity").alias("host"), "lat", "lon", "tz")
    rows = (log.withColumn("host", host).join(places, "host", "left")
            .withColumn("offset", utc_offset_hours("tz", DAY)))
    rows = with_running(rows, keys, DAY, TIE)
    rows = with_trailing(rows, keys, {
        f"last_{c}": (1, lambda w, c=c: F.first(c).over(w)) for c in ("lat", "lon", "offset")})
    return rows.withColumns({
        "travel_miles": haversine("last_lat", "last_lon", "lat", "lon"),
        "zone_shift": F.col("offset") - F.col("last_offset")})


def ewm_of(value: str, alpha: float):
    """Exponentially weighted mean of the window, seeded by its oldest value."""
    def build(w):
        kept = F.collect_list(value).over(w)
        rest = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(F.size(kept) > 0, F.aggregate(
            rest, F.try_element_at(kept, F.lit(1)), lambda acc, x: alpha * x + (1.0 - alpha) * acc))
    return build


def h2h_prior(games: DataFrame, strength: float = 8.0) -> DataFrame:
    """Season-lagged head-to-head rates, smoothed toward the home rate (ordered) and 0.5 (focal)."""
    home = games.groupBy("season").agg(F.sum("home_win").alias("w"), F.count("home_win").alias("n"))
    before = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    base = home.select("season", F.coalesce(F.try_divide(F.sum("w").over(before), F.sum("n").over(before)),
                                            F.lit(0.5)).alias("home_rate"))
    pair = Window.partitionBy("me", "foe").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    views = games.select("season", F.inline(F.array(
        F.struct(F.col("home").alias("me"), F.col("away").alias("foe"), F.col("home_win").alias("won"), F.lit(1).alias("at_home")),
        F.struct(F.col("away").alias("me"), F.col("home").alias("foe"), (1 - F.col("home_win")).alias("won"), F.lit(0).alias("at_home")))))
    seasons = views.groupBy("me", "foe", "season").agg(
        F.sum("won").alias("fw"), F.count("won").alias("fg"),
        F.sum(F.when(F.col("at_home") == 1, F.col("won"))).alias("ow"),
        F.count(F.when(F.col("at_home") == 1, F.col("won"))).alias("og"))
    prior = seasons.select("me", "foe", "season", *[
        F.coalesce(F.sum(c).over(pair), F.lit(0)).cast("double").alias(c) for c in ("fw", "fg", "ow", "og")])
    return (games.join(prior, (games.home == prior.me) & (games.away == prior.foe) & (games.season == prior.season))
            .drop(prior.season).join(base, "season")
            .withColumns({
                "ordered_rate": (F.col("ow") + strength * F.col("home_rate")) / (F.col("og") + strength) - 0.5,
                "ordered_log_games": F.log1p("og"),
                "focal_rate": (F.col("fw") + strength * 0.5) / (F.col("fg") + strength) - 0.5,
                "focal_log_games": F.log1p("fg")}))


def topk_mean(rows: DataFrame, group: Sequence[str], value: str, ks: Sequence[int], tie: str) -> DataFrame:
    """Mean of the k largest values per group, and the share held outside the first k."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), tie))
    ranked = rows.withColumn("__r", rank)
    total = F.sum(value)
    aggs = [F.avg(F.when(F.col("__r") <= k, F.col(value))).alias(f"top{k}_{value}") for k in ks]
    first = F.sum(F.when(F.col("__r") <= ks[0], F.col(value)))
    return ranked.groupBy(*group).agg(*aggs, F.try_divide(total - first, total).alias("depth_share"))


def set_continuity(members: DataFrame, parts: int | None = None) -> DataFrame:
    """Overlap of each entity's member set with its previous contest's, and short histories of it.

    ``parts`` is the number of tasks, for large logs.
    """
    keys = ["entity"]
    sets = (members.groupBy("entity", "season", DAY, "game_id")
            .agg(F.collect_set("member").alias("roster")))
    rows = with_running(sets, keys, DAY, TIE, parts=parts)
    rows = with_trailing(rows, keys, {"prev_roster": (1, lambda w: F.first("roster").over(w))}, parts=parts)
    kept = F.size(F.array_intersect("roster", "prev_roster"))
    seen = F.col("prev_roster").isNotNull()
    rows = rows.withColumns({
        "active": F.size("roster"),
        "continuity": F.when(seen, kept / F.size("roster")),
        "turnover": F.when(seen, F.size("roster") + F.size("prev_roster") - 2 * kept).otherwise(0)})
    return with_trailing(rows, keys, {
        "stability_last5": (5, mean_of("continuity")), "continuity_ewm": (10, ewm_of("continuity", 0.5)),
        "change_last5": (5, mean_of(1.0 - F.col("continuity")))}, parts=parts).drop("roster", "prev_roster")


def roster_churn(members: DataFrame, spans: Sequence[int]) -> DataFrame:
    """Share of members seen in the last n days who are absent now.

    Whom a span knows is the same for all contests of an entity's day: one more from the day after a member's day on, one less when the
    span has passed it, and a day that lies in the span of the member's day before counts once. The sums of these changes per entity
    and day give the members known; those of them who are here are counted in the contest. No row pairs a contest with an absent member.
    """
    known, day = F.col("member").isNotNull(), F.unix_date(DAY)
    seen = (members.dropna(subset=["entity", DAY]).groupBy("entity", "member", DAY).agg(F.collect_set("game_id").alias("games"))
            .withColumn("gap", F.datediff(DAY, F.lag(DAY).over(Window.partitionBy("entity", "member").orderBy(DAY)))))
    here = seen.select("entity", "member", DAY, "gap", F.explode("games").alias("game_id")).groupBy("entity", DAY, "game_id").agg(
        *[F.count(F.when(known & (F.col("gap") <= n), 1)).alias(f"here_{n}") for n in spans])
    changes = []
    for n in spans:
        inside = F.col("gap") <= n
        changes += [(day + 1, n, F.when(inside, 0).otherwise(1)), (day + n + 1, n, F.lit(-1)), (F.when(inside, day - F.col("gap") + n + 1), n, F.lit(1))]
    one = F.array(*[F.struct(at.alias("d"), *[(by if n == m else F.lit(0)).alias(f"known_{m}") for m in spans]) for at, n, by in changes])
    names = [f"known_{n}" for n in spans]
    moved = seen.filter(known).select("entity", F.inline(F.filter(one, lambda c: c["d"].isNotNull())))
    asked = here.select("entity", day.alias("d")).distinct().withColumn("asked", F.lit(True))
    so_far = Window.partitionBy("entity").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each day on which an entity has a contest or a count changes.
    days = (moved.unionByName(asked, allowMissingColumns=True).groupBy("entity", "d").agg(*[F.sum(c).alias(c) for c in names], F.max("asked").alias("asked"))
            .withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in names}).filter("asked").select("entity", F.date_from_unix_date("d").alias(DAY), *names))
    churn = [F.coalesce(F.try_divide(F.col(f"known_{n}") - F.col(f"here_{n}"), F.col(f"known_{n}")), F.lit(0.0)).alias(f"churn_{n}d") for n in spans]
    return here.join(days, ["entity", DAY]).select("entity", DAY, "game_id", *churn)


def season_position(games: DataFrame, order: str = "game_id", parts: int = 1024) -> DataFrame:
    """Position of each contest in the whole history, ordered by day and then by the whole number ``order``.

    Counts per day, and per range of ``order`` within a day, give every range its start, so one task
    orders one range of one day.
    """
    ends = games.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    part = F.floor((F.col(order) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1) * parts)
    rows = attach_row(games, ends).withColumn("__part", part).drop("__lo", "__hi")
    counts = rows.groupBy(DAY, "__part").agg(F.count(F.lit(1)).alias("__n"))
    daily = counts.groupBy(DAY).agg(F.sum("__n").alias("__n"))
    before = Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    start = daily.select(DAY, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    in_day = Window.partitionBy(DAY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.join(start, DAY)
              .select(DAY, "__part", (F.col("__start") + F.coalesce(F.sum("__n").over(in_day), F.lit(0))).alias("__start")))
    return (rows.join(starts, [DAY, "__part"])
            .withColumn("position", F.col("__start") + F.row_number().over(Window.partitionBy(DAY, "__part").orderBy(order)))
            .drop("__start", "__part"))


def recency_weights(games: DataFrame, season_half_life: float, game_half_life: float, floor: float,
                    mode: str = "hybrid") -> DataFrame:
    """Half-life weights by season age and game age, floored, scaled to mean one."""
    placed = season_position(games)
    seasons = (games.select("season").distinct()
               .withColumn("season_age", F.dense_rank().over(Window.orderBy(F.desc("season"))) - 1))
    size = games.agg(F.count(F.lit(1)).alias("n_rows"))
    aged = (attach_row(placed.join(seasons, "season"), size)
            .withColumn("game_age", F.col("n_rows") - F.col("position")))
    by_season = F.pow(F.lit(0.5), F.col("season_age") / season_half_life)
    by_game = F.pow(F.lit(0.5), F.col("game_age") / game_half_life)
    raw = {"season": by_season, "game": by_game, "hybrid": by_season * by_game, "none": F.lit(1.0)}[mode]
    raw_rows = aged.withColumn("raw", F.greatest(F.lit(floor), raw))
    mean = raw_rows.agg(F.avg("raw").alias("mean_raw"))
    return attach_row(raw_rows, mean).withColumn("weight", F.col("raw") / F.col("mean_raw"))


def regime(games: DataFrame) -> DataFrame:
    """Early, middle or late third of the season by position in it."""
    rows = with_running(games, ["season"], DAY, TIE, totals={"season_games": run_count("game_id")})
    at = F.col("seq") / F.col("season_games")
    return rows.withColumn("regime", F.when(at <= 1 / 3, "early").when(at <= 2 / 3, "mid").otherwise("late"))


def even_sample(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """At most k evenly spaced rows per key, first and last kept; needs seq and n."""
    i = F.col("seq") - 1
    # Row i is kept when some j in 0..k-1 has floor(j (n-1) / (k-1)) = i.
    j = F.ceil(i * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.filter((F.col("n") <= k) | (F.floor(j * (F.col("n") - 1) / (k - 1)) == i))


def primary_member(members: DataFrame, history: bool = True) -> DataFrame:
    """Main member per entity-contest (most points), and with ``history`` change flag, earlier starts and lagged form."""
    lead = F.row_number().over(Window.partitionBy("game_id", "entity").orderBy(F.desc("points"), "member"))
    main = members.withColumn("__r", lead).filter("__r = 1").drop("__r")
    if not history:  # rows without entity, member or day have no place in one
        return main.dropna(subset=["entity", "member", DAY])
    rows = with_running(main, ["entity"], DAY, TIE)
    rows = with_trailing(rows, ["entity"], {"__prev": (1, lambda w: F.first("member").over(w))}).drop("seq")
    rows = with_running(rows, ["member"], DAY, [*TIE, "entity"])
    rows = with_trailing(rows, ["member"], {"points_last8": (8, mean_of("points", 3))})
    return rows.withColumns({"changed": (F.col("__prev") != F.col("member")).cast("int"),
                             "prior_starts": F.col("seq") - 1})


def member_prior(members: DataFrame) -> DataFrame:
    """Rolling profile of each member before each contest."""
    rows = with_running(members, ["member"], DAY, [*TIE, "entity"], running={"source_through": run_max(DAY)})
    rows = with_trailing(rows, ["member"], {
        "points_last3": (3, mean_of("points")), "points_last5": (5, mean_of("points")),
        "points_last10": (10, mean_of("points")), "minutes_last5": (5, mean_of("minutes")),
        "ewm": (10, ewm_of("points", 0.45))})
    return rows.withColumn("games_before", F.col("seq") - 1)
