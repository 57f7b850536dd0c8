"""Season tables, standings, play and roster aggregates, coverage and profiles."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.operators.timeline import dealt, run_count, run_max, with_running

DAY, TIE = "game_date", ["game_id"]


def season_summary(log: DataFrame) -> DataFrame:
    return (log.groupBy("season", "entity").agg(
        F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("win"), F.lit(0)).alias("wins"),
        F.sum("score").alias("scored"), F.sum("opp_score").alias("allowed"))
        .withColumns({"win_pct": F.try_divide("wins", "games"),
                      "diff_pg": F.try_divide(F.col("scored") - F.col("allowed"), F.col("games"))}))


def play_summary(plays: DataFrame, side: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Play aggregates per side; contests are summed first, so nothing distinct is expanded.

    ``parts`` is the number of tasks that the contests' sums are dealt over, for large logs.
    """
    v, ok = F.col("epa"), (F.col("epa") > 0).cast("int")
    masks = {"": F.lit(True), "pass_": F.col("is_pass"), "rush_": ~F.col("is_pass"),
             "third_": F.col("down") == 3, "red_": F.col("yards") <= 20}
    first = []
    for p, m in masks.items():
        first += [F.sum(F.when(m, v)).alias(f"{p}epa"), F.count(F.when(m, 1)).alias(f"{p}plays"),
                  F.sum(F.when(m, ok)).alias(f"{p}ok")]
    other = "defense" if side == "offense" else "offense"
    by = [*keys, F.col(side).alias("entity")]
    game = plays.groupBy(*by, "game_id").agg(*first, F.sum(F.col("turnover").cast("int")).alias("turnovers"),
                                             F.max(DAY).alias(DAY), F.collect_set(other).alias("others"))
    total = dealt(game, parts, *keys, "entity").groupBy(*keys, "entity").agg(
        F.count(F.lit(1)).alias("n_games"), F.max(DAY).alias(DAY), F.sum("turnovers").alias("turnovers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("others")))).alias("others"),
        *[F.sum(f"{p}{c}").alias(f"{p}{c}") for p in masks for c in ("epa", "plays", "ok")])
    rates = {f"{p}epa_per_play": F.try_divide(f"{p}epa", f"{p}plays") for p in masks}
    rates |= {f"{p}success": F.try_divide(f"{p}ok", f"{p}plays") for p in masks}
    rates |= {"turnover_rate": F.try_divide("turnovers", "plays"),
              "opponents": F.array_join(F.transform("others", lambda x: x.cast("string")), ",")}
    return total.withColumns(rates).drop("others", *[f"{p}ok" for p in masks])


def both_sides(offense: DataFrame, defense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of the two sides; defensive columns get a prefix."""
    names = [c for c in defense.columns if c not in {*keys, "entity"}]
    d = defense.select(*keys, "entity", *[F.col(c).alias(f"def_{c}") for c in names])
    return offense.join(d, [*keys, "entity"], "full")


def member_rate(rows: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str], min_attempts: int) -> DataFrame:
    """Rate per attempt of members with enough attempts."""
    attempts = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return (rows.withColumn("attempts", attempts).groupBy(*keys)
            .agg(F.sum("attempts").alias("attempts"), F.sum(total).alias("total"))
            .filter(F.col("attempts") >= min_attempts).withColumn("rate", F.try_divide("total", "attempts")))


def pivot_metrics(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long metrics to one column per name."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric_name") == n, F.col("metric_value"))).alias(n) for n in names])


def source_priority(long: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per metric: best source first, then the newest snapshot."""
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    best = F.min_by(F.struct("metric_value", "source", "snapshot_id"), F.struct(rank, -F.col("snapshot_id")))
    return long.groupBy(*keys, "metric_name").agg(best.alias("b")).select(*keys, "metric_name", "b.*")


def roster_rollup(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members summed first, then their team: counts, totals, best scorer and its share."""
    each = members.groupBy(*keys, "member").agg(
        F.sum("points").alias("points"), F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("games"))
    return (each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.sum("points").alias("points"), F.max("points").alias("top_points"),
        F.avg("points").alias("mean_points"), F.sum("minutes").alias("minutes"), F.sum("games").alias("member_games"))
        .withColumns({"top_share": F.try_divide("top_points", "points"),
                      "points_per_game": F.try_divide("points", "member_games")}))


def standings(log: DataFrame, dim: DataFrame, keys: Sequence[str] = ("season", "entity")) -> DataFrame:
    """Records, splits, streak, last ten and division rank per season."""
    keys = list(keys)
    res = F.when(F.col("win").isNull(), "T").when(F.col("win") == 1, "W").otherwise("L")
    rows = with_running(log.withColumn("res", res), keys, DAY, TIE, totals={"games": run_count("game_id")})

    def n(*conds):
        c = conds[0]
        for x in conds[1:]:
            c = c & x
        return F.count(F.when(c, 1))

    r, home, late = F.col("res"), F.col("is_home") == 1, F.col("seq") > F.col("games") - 10
    aggs = {f"{p}{x}": n(m, r == x) for p, m in (("", F.lit(True)), ("h", home), ("a", ~home), ("l", late)) for x in "WLT"}
    aggs |= {f"p{x}": F.max(F.when(r == x, F.col("seq"))) for x in "WLT"}
    out = rows.groupBy(*keys, "games").agg(
        F.sum("score").alias("scored"), F.sum("opp_score").alias("allowed"),
        F.max_by("res", "seq").alias("last"), *[c.alias(k) for k, c in aggs.items()])

    def text(p):
        return F.concat_ws("-", *[F.col(f"{p}{x}").cast("string") for x in "WLT"])

    # The run ends at the newest position of any other result.
    others = F.greatest(*[F.when(F.col("last") != x, F.coalesce(F.col(f"p{x}"), F.lit(0))).otherwise(0) for x in "WLT"])
    out = out.withColumns({
        "win_pct": F.round((F.col("W") + 0.5 * F.col("T")) / F.col("games"), 3),
        "differential": F.col("scored") - F.col("allowed"), "last10": text("l"), "home_record": text("h"),
        "away_record": text("a"), "streak": F.concat("last", (F.col("games") - others).cast("string"))})
    return out.join(dim, "entity").withColumn("rank", division_rank(["season", "conference", "division"]))


def division_rank(partition: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(
        F.desc("win_pct"), F.desc("W"), F.desc("differential"), "name"))


def season_quality(games: DataFrame) -> DataFrame:
    decided = F.col("home_win").isNotNull()
    return games.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.count(F.when(~decided, 1)).alias("ties"),
        F.count(F.when(decided, 1)).alias("binary_games"), F.avg(F.col("home_win").cast("double")).alias("home_rate"),
        F.avg(F.col("home_ml").isNotNull().cast("double")).alias("ml_coverage"),
        F.avg((F.col("spread_line") > 0).cast("double")).alias("home_favourite_share"))


def team_count_check(games: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct entities per season against an expected count."""
    teams = (games.select("season", F.col("home").alias("entity"))
             .union(games.select("season", "away")).distinct())
    return (teams.groupBy("season").agg(F.count(F.lit(1)).alias("observed")).join(expected, "season", "left")
            .withColumn("ok", (F.col("observed") == F.col("expected")).cast("int")))


def coverage(df: DataFrame, day: str, key: str, source: str) -> DataFrame:
    """Date span, counts, and the sources concatenated."""
    per = df.groupBy(source).agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count(F.lit(1)).alias("n"),
                                 F.count(key).alias("k"))
    return per.agg(F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.sum("n").alias("n_rows"),
                   F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"))


def column_coverage(df: DataFrame) -> DataFrame:
    """Non-null count and share of every column, in one pass."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in names])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("filled"),
                 F.try_divide(F.col(c), F.col("__n")).alias("share")) for c in names])))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, median and null rate per column."""
    from boutline.operators.quantiles import exact_quantiles

    one = df.agg(*[x for c in columns for x in (F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"),
                                                F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null"))])
    rows = one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("name"), F.col(f"{c}_lo").alias("low"), F.col(f"{c}_hi").alias("high"),
        F.col(f"{c}_null").alias("null_rate")) for c in columns])))
    med = exact_quantiles(df, columns, [0.5]).select("name", F.col("value").alias("median"))
    return rows.join(med, "name", "left")


def corr_matrix(df: DataFrame, left: Sequence[str], right: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Pearson correlations of column pairs at or above the threshold, one pass."""
    pairs = [(a, b) for a in left for b in right if a != b]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    ).filter(F.abs("r") >= threshold)


def entity_profile(log: DataFrame, start: str, end: str) -> DataFrame:
    """Average form over a date range."""
    return log.filter(F.col(DAY).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).groupBy("entity").agg(
        F.count(F.lit(1)).alias("games"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg("diff").alias("margin"))


def latest_profile(log: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest non-null value of each column per entity."""
    at = F.struct(*order)
    return log.groupBy("entity").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def dedupe_entities(df: DataFrame, key: Column, sources: str, name: str) -> DataFrame:
    """Rows of the same entity clustered by normalised name."""
    per = df.withColumn("key", key).groupBy("key", sources).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("nm"))
    return per.groupBy("key").agg(
        F.min("nm").alias("canonical"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set(sources)), "|").alias("sources"))


def gap_to_success(events: DataFrame, key: str, day: str, tie: Sequence[str], shot: Column, goal: Column) -> DataFrame:
    """Attempts each success needed since the previous one in the same contest."""
    rows = events.withColumns({"__shot": shot.cast("int"), "__goal": goal.cast("int")}).filter("__shot = 1 or __goal = 1")
    rows = with_running(rows, [key], day, tie, running={"shots": run_count(F.when(F.col("__shot") == 1, 1))}).drop("seq")
    rows = with_running(rows, [key], day, tie, running={
        "shots_then": run_max(F.when(F.col("__goal") == 1, F.col("shots")))})
    return rows.filter("__goal = 1").withColumn(
        "needed", F.col("shots") - F.coalesce("shots_then", F.lit(0)) + 1)


def gap_shares(gaps: DataFrame, by: str, limits: Sequence[int] = (5, 10, 15)) -> DataFrame:
    per = gaps.groupBy(by, "game_id").agg(
        F.count(F.lit(1)).alias("g"), F.sum("needed").alias("s"),
        *[F.count(F.when(F.col("needed") <= k, 1)).alias(f"w{k}") for k in limits])
    return per.groupBy(by).agg(
        F.count(F.lit(1)).alias("games"), F.sum("g").alias("goals"), (F.sum("s") / F.sum("g")).alias("mean_needed"),
        *[(F.sum(f"w{k}") / F.sum("g")).alias(f"within_{k}") for k in limits])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("f"))
            .select(*keys, "f.*"))


def leaders(df: DataFrame, value: str, k: int, lower_is_better: bool = False, tie: str = "entity") -> DataFrame:
    order = F.asc(value) if lower_is_better else F.desc(value)
    return df.filter(F.col(value).isNotNull()).orderBy(order, tie).limit(k)


def best_candidate(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest log loss, then Brier, then highest accuracy, then id."""
    cols = [c for c in metrics.columns if c not in by]
    key = F.struct(F.col("log_loss"), F.col("brier"), -F.col("accuracy"), F.col("model_id"))
    best = F.min_by(F.struct(*cols), key).alias("b")
    return (metrics.groupBy(*by) if by else metrics.groupBy()).agg(best).select(*by, "b.*")


def quota_sample(df: DataFrame, window: str, order: Sequence[str], total: int, windows: Sequence) -> DataFrame:
    """First rows per window up to an even quota; the remainder goes to the first windows."""
    base, extra = divmod(total, len(windows))
    quota = F.lit(0)
    for i, w in enumerate(windows):
        quota = F.when(F.col(window) == w, base + (1 if i < extra else 0)).otherwise(quota)
    rank = F.row_number().over(Window.partitionBy(window).orderBy(*order))
    # The literal bound lets Spark drop surplus rows before the shuffle.
    return df.withColumn("pick", rank).filter(F.col("pick") <= base + 1).filter(F.col("pick") <= quota)


def pending(games: DataFrame, done: DataFrame, key: str, per_season: int | None = None, most: int | None = None) -> DataFrame:
    """Contests not processed yet: a work list of at most ``per_season`` per season in date order, and ``most`` in all."""
    todo = games.join(done.select(key), key, "left_anti")
    if per_season is None:
        return todo
    rank = F.row_number().over(Window.partitionBy("season").orderBy(DAY, key))
    todo = todo.withColumn("pick", rank).filter(F.col("pick") <= per_season)
    return todo if most is None else todo.orderBy("season", "pick").limit(most)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key wins; the delta wins a tie."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumn("__d", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, "__d")).alias("r"))
            .select(*keys, "r.*").drop("__d"))


def most_progressed(rows: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """One row per id: the furthest status, the latest on a tie."""
    # Progress order of the shared statuses.
    rank = (F.when(F.col(status) == "final", 3).when(F.col(status) == "live", 2)
            .when(F.col(status) == "postponed", 1).otherwise(0))
    cols = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(rank, *order)).alias("r")).select(key, "r.*"))


def collapse_rescheduled(rows: DataFrame, key: str, status: str, start: str) -> DataFrame:
    """One row per id: a superseded postponement goes, else the latest start stays."""
    cols = [c for c in rows.columns if c != key]
    keep = F.struct((F.col(status) != "postponed").cast("int"), F.col(start))
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), keep).alias("r")).select(key, "r.*")


def later_source_wins(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two sources; where both hold a key the second one's row stays."""
    return second.unionByName(first.join(second.select(*keys), list(keys), "left_anti"))


def next_date(games: DataFrame, after: str) -> DataFrame:
    return games.filter(F.col(DAY) > F.to_date(F.lit(after))).agg(F.min(DAY).alias("next_date"))


def last_seasons(games: DataFrame, as_of: str, k: int) -> DataFrame:
    """The k newest seasons whose last contest is on or before the date."""
    ends = games.groupBy("season").agg(F.max(DAY).alias("last_date"), F.count(F.lit(1)).alias("games"))
    return ends.filter(F.col("last_date") <= F.to_date(F.lit(as_of))).orderBy(F.desc("season")).limit(k)


def totals_by(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], having: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).filter(having)


def date_windows(spark, start: str, end: str, days: int) -> DataFrame:
    """Consecutive windows of n days covering the span; the last one is cut at the end."""
    return spark.sql(
        "SELECT w AS window_start, least(date_add(w, :d - 1), to_date(:e)) AS window_end FROM "
        "(SELECT explode(sequence(to_date(:s), to_date(:e), make_interval(0, 0, 0, :d))) AS w)",
        args={"s": start, "e": end, "d": days})
