"""In-contest states: analytic win probability, monotone surfaces, audits."""

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from boutline.functions.odds import brier, log_loss, normal_wp
from boutline.operators.folds import with_grid

STEPS = 40


def ols_normal_wp(states: DataFrame) -> DataFrame:
    """Drift and spread of the remaining margin: least squares through the origin."""
    x, y = F.col("frac"), (F.col("final_margin") - F.col("margin")).cast("double")
    live = states.filter(x > 1e-6)
    # sum((y - mu x)^2 / x) needs only five sums.
    s = live.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y / x).alias("yyx"),
                 F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.count(F.lit(1)).alias("n"))
    mu = F.col("xy") / F.col("xx")
    var = (F.col("yyx") - 2 * mu * F.col("sy") + mu * mu * F.col("sx")) / F.col("n")
    return s.select(mu.alias("mu"), F.sqrt(var).alias("sigma"), "n")


#: Drift and spread each descent begins from.
STARTS = [(mu, sigma) for mu in (-5.0, 0.0, 5.0) for sigma in (4.0, 12.0)]


def fit_normal_wp(states: DataFrame, objective: str = "log_loss", buckets: int = 3600, steps: int = 40,
                  starts: Sequence[tuple[float, float]] = STARTS) -> tuple[float, float]:
    """Drift and spread with the lowest loss (``log_loss`` or ``brier``), by scoring steps from several starts.

    States are counted per (margin, bucket of the fraction left, outcome), each bucket with its own mean fraction. A step takes loss,
    slope and curvature of all starts from one aggregate over these counts; one row per start comes to the driver. A step that raises
    the loss is taken back and damped. States without time left do not depend on either number.
    """
    live = states.filter((F.col("frac") > 1e-6) & F.col("home_won").isNotNull())
    counts = (live.groupBy("margin", F.ceil(F.col("frac") * buckets).alias("cell"), F.col("home_won").cast("double").alias("y"))
              .agg(F.count(F.lit(1)).alias("k"), F.avg("frac").alias("frac")).persist())
    root = F.sqrt("frac")
    p = _normal_at(F.col("margin"), F.col("frac"), F.col("mu"), F.col("sigma"))
    z = (F.col("margin") + F.col("mu") * F.col("frac")) / (F.col("sigma") * root)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    if objective == "log_loss":
        room = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))
        slope, bend, loss = (F.col("p") - F.col("y")) * density / room, density * density / room, log_loss("p", "y")
    else:
        slope, bend, loss = 2 * (F.col("p") - F.col("y")) * density, 2 * density * density, brier("p", "y")
    by_mu, by_log_sigma = root / F.col("sigma"), -z

    def at(points: list[tuple[float, float]]) -> dict[int, Row]:
        rows = with_grid(counts, [{"start": i, "mu": mu, "sigma": sigma} for i, (mu, sigma) in enumerate(points)]).withColumn("p", p)
        sums = {"loss": loss, "g1": slope * by_mu, "g2": slope * by_log_sigma, "h11": bend * by_mu * by_mu,
                "h12": bend * by_mu * by_log_sigma, "h22": bend * by_log_sigma * by_log_sigma}
        return {r.start: r for r in rows.groupBy("start").agg(*[(F.sum(v * F.col("k")) / F.sum("k")).alias(n) for n, v in sums.items()]).collect()}

    points = list(starts)
    now, damp = at(points), [1e-3] * len(points)
    try:
        for _ in range(steps if now else 0):
            tried = []
            for i, (mu, sigma) in enumerate(points):
                r, d = now[i], damp[i]
                a, c = r.h11 * (1 + d) + 1e-12, r.h22 * (1 + d) + 1e-12
                wide = a * c - r.h12 * r.h12
                step = (r.h12 * r.g2 - c * r.g1) / wide, (r.h12 * r.g1 - a * r.g2) / wide
                tried.append((mu + max(-5.0, min(5.0, step[0])), sigma * math.exp(max(-1.0, min(1.0, step[1])))))
            then, moved = at(tried), 0.0
            for i, point in enumerate(tried):
                if then[i].loss <= now[i].loss:
                    moved = max(moved, abs(point[0] - points[i][0]), abs(point[1] - points[i][1]))
                    points[i], now[i], damp[i] = point, then[i], damp[i] / 5
                else:
                    # A rise within rounding means that the start has arrived.
                    risen = then[i].loss - now[i].loss > 1e-12
                    damp[i], moved = damp[i] * 10, max(moved, 1.0 if risen and damp[i] < 1e6 else 0.0)
            if moved < 1e-7:
                break
    finally:
        counts.unpersist()
    if not now:
        return points[0]
    return points[min(now, key=lambda i: (now[i].loss, i))]


def _normal_at(m: Column, f: Column, mu: Column, sigma: Column) -> Column:
    from boutline.functions.odds import normal_cdf

    z = (m + mu * f) / F.greatest(F.lit(1e-6), sigma * F.sqrt(f))
    over = F.when(m > 0, 1.0).when(m < 0, 0.0).otherwise(0.5)
    return F.when(f <= 1e-6, over).otherwise(normal_cdf(z))


def blend_wp(learned: Column, analytic: Column, frac, alpha: float, power: float = 0.0) -> Column:
    """Learned probability mixed with the analytic one; the mix fades as frac^power."""
    a = F.lit(alpha) * F.pow(F.col(frac) if isinstance(frac, str) else frac, F.lit(power))
    return (1.0 - a) * learned + a * analytic


def raw_surface(states: DataFrame, margins: tuple[int, int], mu: float, sigma: float, alpha: float, power: float) -> DataFrame:
    """Observed win rate per (margin, time cell), smoothed, mixed with the analytic probability on the grid."""
    lo, hi = margins
    cell = F.floor(F.col("frac") * STEPS + 0.5).cast("int")
    seen = states.filter("home_won is not null").groupBy(
        F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("margin"))).alias("margin"), cell.alias("j")).agg(
        F.sum("home_won").alias("k"), F.count(F.lit(1)).alias("n"))
    grid = (states.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("margin"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(STEPS)))).withColumn("frac", F.col("j") / float(STEPS)))
    analytic = normal_wp("margin", "frac", mu, sigma)
    out = grid.join(seen, ["margin", "j"], "left").withColumn("analytic", analytic)
    learned = (F.coalesce("k", F.lit(0)) + 2.0 * F.col("analytic")) / (F.coalesce("n", F.lit(0)) + 2.0)
    return out.select("margin", "j", "frac", "analytic", blend_wp(learned, F.col("analytic"), "frac", alpha, power).alias("p"))


def monotone_surface(grid: DataFrame) -> DataFrame:
    """A lead gains and a deficit loses as time runs out; more margin is never worse."""
    later = Window.partitionBy("margin").orderBy(F.desc("j"))
    timed = grid.withColumn("p_time", F.when(F.col("margin") > 0, F.max("p").over(later))
                            .when(F.col("margin") < 0, F.min("p").over(later)).otherwise(F.col("p")))
    return timed.withColumn("p_mono", F.max("p_time").over(Window.partitionBy("j").orderBy("margin")))


def surface_score(states: DataFrame, surface: DataFrame, margins: tuple[int, int], linear: bool = False,
                  name: str = "p") -> DataFrame:
    """Look states up on a surface: next grid point, or linear in time between neighbours."""
    lo, hi = margins
    m = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("margin")))
    up = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.ceil(F.col("frac") * STEPS - 1e-9))).cast("int")
    s = F.broadcast(surface.select(F.col("margin").alias("__m"), F.col("j").alias("__j"), F.col("p_mono").alias("__p")))
    rows = states.withColumns({"__m": m, "__j": up}).join(s, ["__m", "__j"], "left").withColumnRenamed("__p", "__up")
    if not linear:
        return rows.withColumn(name, F.col("__up")).drop("__m", "__j", "__up")
    rows = rows.drop("__j").withColumn("__j", F.greatest(F.lit(0), F.floor(F.col("frac") * STEPS + 1e-9)).cast("int"))
    rows = rows.join(s, ["__m", "__j"], "left")
    part = F.col("frac") * STEPS - F.col("__j")
    return rows.withColumn(name, F.col("__p") + (F.col("__up") - F.col("__p")) * F.greatest(F.lit(0.0), part)).drop("__m", "__j", "__up", "__p")


def monotone_audit(surface: DataFrame, margins: tuple[int, int], sweep: int = 400, linear: bool = False) -> DataFrame:
    """Wrong-way steps in time (off the surface's own grid) and in margin, per margin."""
    lo, hi = margins
    pts = (surface.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("margin"))
           .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(sweep)))).withColumn("frac", 1.0 - F.col("i") / float(sweep)))
    scored = surface_score(pts, surface, margins, linear)
    in_time = F.lag("p").over(Window.partitionBy("margin").orderBy("i"))
    in_margin = F.lag("p").over(Window.partitionBy("i").orderBy("margin"))
    step = scored.withColumns({"dt": F.col("p") - in_time, "dm": F.col("p") - in_margin})
    wrong = F.when(F.col("margin") > 0, -F.col("dt")).when(F.col("margin") < 0, F.col("dt"))
    return step.groupBy("margin").agg(
        F.count(F.when(wrong > 1e-9, 1)).alias("time_drops"), F.coalesce(F.max(F.when(wrong > 1e-9, wrong)), F.lit(0.0)).alias("worst"),
        F.count(F.when(F.col("dm") < -1e-9, 1)).alias("margin_drops"))


def augment_missing(df: DataFrame, columns: Sequence[str], copies: int) -> DataFrame:
    """The rows plus masked copies of them, so a model meets unobserved situations."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return out.withColumns({c: F.when(F.col("copy") == 0, F.col(c)) for c in columns})


def row_envelope(states: DataFrame, extra: Sequence[str], grid: Sequence[float], back: int,
                 model: Callable[[Column, Column], Column]) -> DataFrame:
    """Per-state monotone envelope of a model that uses extra state columns.

    Candidate margins m-back..m and the state's own time plus later grid times are scored; a lead takes
    the maximum over time, a deficit the minimum, a tie its own time, and the best candidate margin is kept.

    The grid is scored once per distinct (margin, extra): for every candidate margin a row of the table holds the maxima (minima) over
    the rest of the grid from each of its times on. States look their rest up and score their own time in place, so none is copied.
    States without margin are dropped.
    """
    key, times = ["margin", *extra], sorted(float(g) for g in grid)
    cells = states.select(*key).distinct().withColumn("__back", F.explode(F.sequence(F.lit(0), F.lit(back))))
    cells = cells.withColumns({"__m": F.col("margin") - F.col("__back"), "__t": F.explode(F.array(*map(F.lit, range(len(times)))))})
    cells = cells.withColumn("__q", model(F.col("__m"), F.element_at(F.array(*map(F.lit, times)), F.col("__t") + 1)))
    line = F.transform(F.array_sort(F.collect_list(F.struct("__t", "__q"))), lambda c: c["__q"])
    lines = cells.groupBy(*key, "__back", "__m").agg(line.alias("__line"))
    rest = F.transform("__line", lambda _, i: F.slice("__line", i + 1, len(times)))
    lines = lines.withColumn("__rest", F.when(F.col("__m") > 0, F.transform(rest, F.array_max)).when(F.col("__m") < 0, F.transform(rest, F.array_min)))
    table = lines.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__back", "__rest"))).alias("__rests"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    found = states.alias("s").join(table.alias("t"), reduce(Column.__and__, same)).select("s.*", "t.__rests")
    found = found.withColumn("__at", sum((F.coalesce(F.lit(g) < F.col("frac") - 1e-12, F.lit(True)).cast("int") for g in times), F.lit(1)))

    def best(k: Column) -> Column:
        m = F.col("margin") - k
        own, later = model(m, F.col("frac")), F.get(F.col("__rests")[k], F.col("__at") - 1)
        both = F.array(own, later)
        return F.when(m > 0, F.array_max(both)).when(m < 0, F.array_min(both)).otherwise(own)

    # A loop over the candidates inside of the row: written out for each of them, a long model is too much code to compile.
    envelope = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(back)), best))
    return found.filter("margin is not null").select(*states.columns, envelope.alias("p_envelope"))


def snapshots(plays: DataFrame, league: str) -> DataFrame:
    """Labelled states from plays: incomplete plays and contests without a winner are dropped.

    ``plays``: game_id, ord, period, clock, home_score, away_score, optional extra columns.
    """
    from boutline.functions.clocks import clock_seconds, frac_remaining_clock

    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    final = plays.groupBy("game_id").agg(
        F.max_by("home_score", F.when(F.col("home_score").isNotNull(), F.col("ord"))).alias("fh"),
        F.max_by("away_score", F.when(F.col("away_score").isNotNull(), F.col("ord"))).alias("fa"))
    final = final.filter("fh <> fa").select("game_id", (F.col("fh") > F.col("fa")).cast("int").alias("home_won"))
    secs = clock_seconds("clock")
    return plays.filter(scored & F.col("period").isNotNull()).join(final, "game_id").withColumns({
        "clock_seconds": secs, "frac": frac_remaining_clock(league, F.col("period"), secs),
        "margin": F.col("home_score") - F.col("away_score")})
