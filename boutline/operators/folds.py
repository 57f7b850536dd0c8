"""Walk-forward folds, splits, calibration, blending and model choice.

Parameter grids are fixed arrays exploded next to each row and aggregated at once, so only one
partial result per grid point leaves a task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.functions.odds import brier, clamp, hit, log_loss, logit, sigmoid
from boutline.operators.joins import attach_row  # noqa: F401
from boutline.operators.quantiles import quantile_row
from boutline.operators.timeline import run_count, with_running
from boutline.session import stored

EARLIER = (Window.unboundedPreceding, -1)


def with_grid(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Every row beside every point of a fixed grid."""
    points = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return df.select("*", F.inline(F.array(*points)))


def walk_forward_folds(games: DataFrame, min_train: int, holdout: int = 0, span: int | None = None) -> DataFrame:
    """One row per test season: its training seasons and contests; the last ``holdout`` seasons are flagged."""
    s = games.groupBy("season").agg(F.count(F.lit(1)).alias("test_games"))
    w = Window.orderBy("season").rowsBetween(-span if span else Window.unboundedPreceding, -1)
    out = s.select(
        F.col("season").alias("test_season"), "test_games", F.count(F.lit(1)).over(w).alias("train_seasons"),
        F.min("season").over(w).alias("train_start"), F.max("season").over(w).alias("train_end"),
        F.coalesce(F.sum("test_games").over(w), F.lit(0)).alias("train_games"),
        (F.row_number().over(Window.orderBy(F.desc("season"))) <= holdout).cast("int").alias("is_holdout"))
    return out.filter(F.col("train_seasons") >= min_train)


def split_by_game(games: DataFrame, cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """Chronological split by contest: cuts are (name, cumulative share)."""
    from boutline.operators.history import season_position

    n = games.agg(F.count(F.lit(1)).alias("__all"))
    rows = attach_row(season_position(games), n)
    part = F.lit(cuts[-1][0])
    for name, upto in reversed(cuts[:-1]):
        part = F.when(F.col("position") <= F.floor(F.col("__all") * upto), name).otherwise(part)
    return rows.withColumn("part", part).drop("__all")


def split_stratified(games: DataFrame, label: str, share: float, salt: str = "") -> DataFrame:
    """A fixed share of each label held out, chosen by a hash of the contest id."""
    h = F.md5(F.concat(F.col("game_id").cast("string"), F.lit(salt)))
    rows = games.withColumns({"__h": h, "__b": F.substring(h, 1, 4)})
    rows = with_running(rows, [label], "__b", ["__h", "game_id"], totals={"__n": run_count("game_id")})
    return rows.withColumn("part", F.when(F.col("seq") <= F.floor(F.col("__n") * share), "validation").otherwise("fit")
                           ).drop("__h", "__b", "__n", "seq")


def robust_scale(rows: DataFrame, columns: Sequence[str], seasons: Sequence[int], limit: float = 6.0) -> DataFrame:
    """Scale each season by the median and IQR of all earlier seasons, clipped."""
    folds = F.array(*[F.lit(s) for s in seasons])
    train = rows.select(*columns, F.explode(F.filter(folds, lambda s: s > F.col("season"))).alias("season"))
    stats = quantile_row(train, columns, {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["season"])
    out = rows.join(stats, "season")
    scaled = {}
    for c in columns:
        scale = F.greatest((F.col(f"{c}_q3") - F.col(f"{c}_q1")) / 1.349, F.lit(1e-6))
        scaled[f"{c}_scaled"] = clamp((F.col(c) - F.col(f"{c}_med")) / scale, -limit, limit)
    return out.withColumns(scaled)


def bin_of(p, bins: int = 10) -> Column:
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")


def histogram_binning(pred: DataFrame, by: Sequence[str] = ("model_id",), bins: int = 10) -> DataFrame:
    """Replace p by the observed rate of its bin over all earlier seasons; an unseen bin gives 0.5."""
    by = list(by)
    rows = pred.withColumn("bin", bin_of("p", bins))
    cells = rows.groupBy(*by, "season", "bin").agg(F.sum("y").alias("k"), F.count("y").alias("n"))
    frame = (pred.select(*by, "season").distinct()
             .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    w = Window.partitionBy(*by, "bin").orderBy("season").rowsBetween(*EARLIER)
    table = frame.join(cells, [*by, "season", "bin"], "left").select(
        *by, "season", "bin", F.coalesce(F.try_divide(F.sum("k").over(w), F.sum("n").over(w)), F.lit(0.5)).alias("calibrated"))
    return rows.join(table, [*by, "season", "bin"])


def grouped_calibration(train: DataFrame, test: DataFrame, key: str, min_rows: int = 5, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Histogram binning per key, of each ``by``, with a table over all keys for those that have too few rows."""
    by = list(by)
    t = train.withColumn("bin", bin_of("p", bins))
    per_key = t.groupBy(*by, key).agg(F.count(F.lit(1)).alias("key_rows")).filter(F.col("key_rows") >= min_rows)
    cells = t.groupBy(*by, key, "bin").agg(F.avg(F.col("y").cast("double")).alias("key_rate"))
    world = t.groupBy(*by, "bin").agg(F.avg(F.col("y").cast("double")).alias("all_rate"))
    half = F.lit(0.5)
    return (test.withColumn("bin", bin_of("p", bins)).join(per_key, [*by, key], "left").join(cells, [*by, key, "bin"], "left")
            .join(world, [*by, "bin"], "left")
            .withColumn("calibrated", F.when(F.col("key_rows").isNotNull(), F.coalesce("key_rate", half))
                        .otherwise(F.coalesce("all_rate", half))))


def temperature(pred: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Temperature with the lowest log loss: a coarse grid over 0.1..3, then a fine one around the best.

    Equal predictions with equal outcomes are one row with their number, worked out once for both grids.
    """
    by = list(by)
    counts = stored(pred.groupBy(*by, "p", "y").agg(F.count(F.lit(1)).alias("n")), "scores")

    def best(rows, points):
        t = with_grid(rows, points).withColumn("temp", F.round(F.col("centre") + F.col("step"), 2)).filter("temp >= 0.1 and temp <= 3.0")
        own = log_loss(sigmoid(logit("p") / F.col("temp")), "y")
        loss = t.withColumn("own", own).groupBy(*by, "temp").agg(F.try_divide(F.sum(F.col("own") * F.col("n")), F.sum(F.when(F.col("own").isNotNull(), F.col("n")))).alias("loss"))
        return loss.groupBy(*by).agg(F.min_by("temp", F.struct("loss", "temp")).alias("centre"), F.min("loss").alias("loss"))

    coarse = best(counts.withColumn("centre", F.lit(0.0)), [{"step": round(0.1 * i, 2)} for i in range(1, 31)])
    fine = best(counts.join(coarse.select(*by, "centre"), by), [{"step": round(0.01 * i, 2)} for i in range(-10, 11)])
    return fine.withColumnRenamed("centre", "temperature")


def _losses(p) -> list[Column]:
    return [F.sum(log_loss(p, "y")).alias("ll"), F.sum(brier(p, "y")).alias("br"), F.sum(hit(p, "y")).alias("ok"),
            F.count(F.lit(1)).alias("n")]


def _past(sums: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Mean metrics of each candidate over everything before the row's season."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(*EARLIER)
    n = F.sum("n").over(w)
    return sums.select(*by, order, n.alias("past_n"), (F.sum("ll").over(w) / n).alias("log_loss"),
                       (F.sum("br").over(w) / n).alias("brier"), (F.sum("ok").over(w) / n).alias("accuracy"))


def blend(wide: DataFrame, candidates: Sequence[dict], default: str) -> DataFrame:
    """Weight blend chosen per season from earlier seasons only.

    Each candidate has ``blend_id`` and a weight ``w_<model>`` per p_<model> column.
    """
    models = [k[2:] for k in candidates[0] if k.startswith("w_")]

    def mix():
        total = sum((F.col(f"w_{m}") for m in models[1:]), F.col(f"w_{models[0]}"))
        return sum((F.col(f"w_{m}") * F.col(f"p_{m}") for m in models[1:]), F.col(f"w_{models[0]}") * F.col(f"p_{models[0]}")) / total

    tried = with_grid(wide, candidates).withColumn("mixed", mix())
    sums = tried.groupBy("season", "blend_id").agg(*_losses("mixed"))
    past = _past(sums, ["blend_id"], "season")
    key = F.struct(F.col("log_loss"), F.col("brier"), -F.col("accuracy"), F.col("blend_id"))
    pick = past.groupBy("season").agg(F.coalesce(
        F.min_by("blend_id", F.when(F.col("past_n").isNotNull(), key)), F.lit(default)).alias("blend_id"))
    weights = with_grid(wide.sparkSession.range(1).drop("id"), candidates)
    return (wide.join(pick, "season").join(F.broadcast(weights), "blend_id")
            .withColumn("p", mix()).drop(*[f"w_{m}" for m in models]))


def simplex(models: Sequence[str], step: float) -> list[dict]:
    """All weight vectors on the simplex with the given step."""
    k = round(1 / step)

    def fill(left, m):
        if m == 1:
            yield (left,)
        else:
            for i in range(left + 1):
                for rest in fill(left - i, m - 1):
                    yield (i, *rest)

    return [{"blend_id": "-".join(f"{i:02d}" for i in v), **{f"w_{m}": i / k for m, i in zip(models, v)}}
            for v in fill(k, len(models))]


def regime_blend(wide: DataFrame, models: Sequence[str], step: float, default: dict) -> DataFrame:
    """Simplex weights per season and regime, from past rows of the same or an earlier regime.

    ``wide`` carries ``regime`` (early, mid, late).  Training rows are earlier seasons' rows up to
    that regime plus the current season's rows of strictly earlier regimes.
    """
    # Order of the season thirds.
    stage = F.when(F.col("regime") == "early", 0).when(F.col("regime") == "mid", 1).otherwise(2)
    grid = simplex(models, step)
    mixed = sum((F.col(f"w_{m}") * F.col(f"p_{m}") for m in models[1:]), F.col(f"w_{models[0]}") * F.col(f"p_{models[0]}"))
    rows = with_grid(wide.withColumn("stage", stage), grid).withColumn("mixed", mixed)
    sums = rows.groupBy("season", "stage", "blend_id").agg(*_losses("mixed"))
    # A cell feeds its own stage and later ones: of later seasons, and (only later stages) of its own.
    fed = sums.withColumn("for_stage", F.explode(F.sequence(F.col("stage"), F.lit(2))))
    seasonal = fed.groupBy("season", "for_stage", "blend_id").agg(
        *[F.sum(c).alias(c) for c in ("ll", "br", "ok", "n")],
        *[F.sum(F.when(F.col("for_stage") > F.col("stage"), F.col(c))).alias(f"own_{c}") for c in ("ll", "br", "ok", "n")])
    # Every (season, stage, candidate) needs a row, even if that season has no rows in the stage.
    w = Window.partitionBy("for_stage", "blend_id").orderBy("season").rowsBetween(*EARLIER)
    total = {c: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(F.col(f"own_{c}"), F.lit(0)) for c in ("ll", "br", "ok", "n")}
    scored = seasonal.select("season", "for_stage", "blend_id", *[v.alias(k) for k, v in total.items()])
    key = F.struct(-(F.col("ok") / F.col("n")), F.col("ll") / F.col("n"), F.col("br") / F.col("n"), F.col("blend_id"))
    pick = scored.groupBy("season", F.col("for_stage").alias("stage")).agg(
        F.min_by("blend_id", F.when(F.col("n") > 0, key)).alias("blend_id"))
    weights = with_grid(wide.sparkSession.range(1).drop("id"), grid)
    out = wide.withColumn("stage", stage).join(pick, ["season", "stage"]).join(F.broadcast(weights), "blend_id", "left")
    w_of = {m: F.coalesce(F.col(f"w_{m}"), F.lit(default[m])) for m in models}
    p = sum((w_of[m] * F.col(f"p_{m}") for m in models[1:]), w_of[models[0]] * F.col(f"p_{models[0]}"))
    return out.withColumn("p", p).drop("stage", *[f"w_{m}" for m in models])


def average_weight(wide: DataFrame, a: str, b: str, space: str = "logit", score: str = "log_loss") -> DataFrame:
    """Best two-model weight per season from earlier seasons, over 81 weights from -0.5 to 1.5."""
    grid = [{"weight": round(-0.5 + 0.025 * i, 3)} for i in range(81)]
    w = F.col("weight")
    if space == "logit":
        p = sigmoid((1 - w) * logit(f"p_{a}") + w * logit(f"p_{b}"))
    else:
        p = clamp((1 - w) * F.col(f"p_{a}") + w * F.col(f"p_{b}"), 1e-6, 1 - 1e-6)
    sums = with_grid(wide, grid).withColumn("mixed", p).groupBy("season", "weight").agg(*_losses("mixed"))
    past = _past(sums, ["weight"], "season").filter("past_n is not null")
    first, second = (F.col("log_loss"), -F.col("accuracy")) if score == "log_loss" else (-F.col("accuracy"), F.col("log_loss"))
    return past.groupBy("season").agg(F.min_by("weight", F.struct(first, second, w)).alias("weight"),
                                      F.max("past_n").alias("train_games"))


def choose_calibrator(views: DataFrame, objective: str = "joint", margin: float = 0.0, prefer: str = "platt") -> DataFrame:
    """Method with the best weighted mean metrics; ``prefer`` stays when within the margin.

    ``views`` has method, weight, accuracy, log_loss, brier.
    """
    w = F.sum("weight")
    m = views.groupBy("method").agg(*[(F.sum(F.col("weight") * F.col(c)) / w).alias(c) for c in ("accuracy", "log_loss", "brier")])
    main = {"log_loss": F.col("log_loss"), "brier": F.col("brier"),
            "joint": 0.5 * F.col("log_loss") + 0.5 * F.col("brier")}[objective]
    second = F.col("brier") if objective == "log_loss" else F.col("log_loss")
    key = F.struct(main.alias("k1"), second.alias("k2"), (-F.col("accuracy")).alias("k3"), F.col("method"))
    best = m.agg(F.min(key).alias("best"), F.min(F.when(F.col("method") == prefer, main)).alias("kept"))
    keep = F.col("kept").isNotNull() & (F.col("kept") - F.col("best.k1") <= margin) & F.lit(margin > 0)
    return best.select(F.when(keep, prefer).otherwise(F.col("best.method")).alias("method"),
                       F.col("best.method").alias("best_method"), F.col("best.k1").alias("objective"))


def select_config(metrics: DataFrame, by: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Simplest configuration within the tolerance of the best accuracy, then the lowest log loss."""
    top = metrics.groupBy(*by).agg(F.max("accuracy").alias("__top"))
    ok = metrics.join(top, list(by)).filter(F.col("accuracy") >= F.col("__top") - tolerance)
    cols = [c for c in metrics.columns if c not in by]
    key = F.struct(F.col("complexity"), F.col("log_loss"), -F.col("accuracy"), F.col("model_id"))
    return ok.groupBy(*by).agg(F.min_by(F.struct(*cols), key).alias("c")).select(*by, "c.*")


def select_shippable(candidates: DataFrame) -> DataFrame:
    """Lowest log loss among candidates that pass both monotone checks, Brier breaks a tie; no row if none passes."""
    ok = candidates.filter((F.col("margin_ok") == 1) & (F.col("time_ok") == 1))
    cols = candidates.columns
    return ok.agg(F.min_by(F.struct(*cols), F.struct("log_loss", "brier", "model_id")).alias("c")).filter("c is not null").select("c.*")


def weighted_score(df: DataFrame, weights: dict[str, float]) -> Column:
    """Fixed weights on scaled features, divided by the sum of their sizes."""
    size = sum(abs(w) for w in weights.values()) or 1.0
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.coalesce(F.col(c), F.lit(0.0))
    return total / size


def recency_grid(games: DataFrame, modes: Sequence[str], season_half_lives: Sequence[float],
                 game_half_lives: Sequence[float], floors: Sequence[float]) -> DataFrame:
    """Mean raw recency weight and effective sample size per configuration and season."""
    from boutline.operators.history import season_position

    n = games.agg(F.count(F.lit(1)).alias("__all"))
    age = Window.orderBy(F.desc("season"))
    seasons = games.select("season").distinct().withColumn("season_age", F.dense_rank().over(age) - 1)
    aged = attach_row(season_position(games), n).join(seasons, "season")
    grid = [{"mode": m, "season_hl": float(s), "game_hl": float(g), "floor_w": float(f)}
            for m in modes for s in season_half_lives for g in game_half_lives for f in floors]
    rows = with_grid(aged.select("season", "season_age", (F.col("__all") - F.col("position")).alias("game_age")), grid)
    by_s, by_g = F.pow(F.lit(0.5), F.col("season_age") / F.col("season_hl")), F.pow(F.lit(0.5), F.col("game_age") / F.col("game_hl"))
    raw = F.when(F.col("mode") == "season", by_s).when(F.col("mode") == "game", by_g).when(F.col("mode") == "hybrid", by_s * by_g).otherwise(1.0)
    w = F.greatest(F.col("floor_w"), raw)
    return rows.groupBy("mode", "season_hl", "game_hl", "floor_w").agg(
        F.count(F.lit(1)).alias("n"), F.avg(w).alias("mean_weight"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))
