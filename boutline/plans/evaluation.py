"""Forecast evaluation queries."""

import math

from pyspark.sql import functions as F

from boutline.functions.odds import implied_prob
from boutline.operators import evaluate as E, quantiles as Q
from boutline.plans.oracle import hit, log_loss, over, wilson
from boutline.plans.registry import query

METRICS = f"COUNT(*) AS n, AVG({hit()}) AS accuracy, AVG({log_loss()}) AS log_loss, AVG((p - y) * (p - y)) AS brier"
MODELS = ["form", "market", "prior"]


def normal_cdf(z: str) -> str:
    """The rational erfc fit as SQL."""
    x = f"(({z}) / -1.4142135623730951e0)"
    t = f"(1e0 / (1e0 + 0.5e0 * ABS({x})))"
    poly = "0.17087277e0"
    for c in ["-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"]:
        poly = f"({c}e0 + {t} * {poly})"
    tail = f"({t} * EXP(-{x} * {x} + {poly}))"
    return f"(0.5e0 * CASE WHEN {x} >= 0 THEN {tail} ELSE 2e0 - {tail} END)"


@query("model_scores", "model_id:s season:b n:b accuracy:d log_loss:d brier:d", over("preds", f"""
 SELECT model_id, season, {METRICS} FROM preds GROUP BY model_id, season UNION ALL SELECT model_id, NULL, {METRICS} FROM preds GROUP BY model_id"""))
def model_scores(t):
    return E.metrics_rollup(t.preds())


@query("reliability", "model_id:s bin:b n:b predicted:d actual:d gap:d small:b", over("preds", """
 SELECT m.model_id, b.bin, COALESCE(n, 0) AS n, predicted, actual, actual - predicted AS gap, CASE WHEN COALESCE(n, 0) < 150 THEN 1 ELSE 0 END AS small
 FROM (SELECT DISTINCT model_id FROM preds) m CROSS JOIN range(10) b(bin)
 LEFT JOIN (SELECT model_id, LEAST(FLOOR(p * 10), 9) AS bin, COUNT(*) AS n, AVG(p) AS predicted, AVG(CAST(y AS DOUBLE)) AS actual FROM preds GROUP BY 1, 2) r
 ON r.model_id = m.model_id AND r.bin = b.bin"""))
def reliability(t):
    return E.reliability(t.preds(), ["model_id"])


@query("calibration_error", "model_id:s ece:d mce:d max_gap:d", over("preds", """
 SELECT model_id, SUM(n * g) / SUM(n) AS ece, MAX(g) AS mce, MAX(CASE WHEN n >= 30 THEN g END) AS max_gap
 FROM (SELECT model_id, LEAST(FLOOR(p * 10), 9) AS bin, COUNT(*) AS n, ABS(AVG(CAST(y AS DOUBLE)) - AVG(p)) AS g FROM preds GROUP BY 1, 2) x GROUP BY 1"""))
def calibration_error(t):
    return E.calibration_error(t.preds(), ["model_id"])


TIER_COLS = "model_id:s tier:d n:b correct:b coverage:d accuracy:d small_sample:b wilson_low:d wilson_high:d"


def _tiers(banded):
    cond = "c >= lo AND c < hi" if banded else "c >= lo"
    return over("preds", f"""SELECT model_id, lo AS tier, n, k AS correct, CAST(n AS DOUBLE) / total AS coverage, k / n AS accuracy,
 CASE WHEN n < 150 THEN 1 ELSE 0 END AS small_sample, {wilson('k', 'n', '-')} AS wilson_low, {wilson('k', 'n', '+')} AS wilson_high
 FROM (SELECT model_id, lo, COUNT(*) AS n, SUM(h) AS k, MAX(total) AS total FROM (SELECT model_id, GREATEST(p, 1e0 - p) AS c, {hit()} AS h,
  COUNT(*) OVER (PARTITION BY model_id) AS total FROM preds) a JOIN (VALUES (0.5e0, 0.55e0), (0.55e0, 0.6e0), (0.6e0, 0.65e0), (0.65e0, 0.7e0), (0.7e0, 0.8e0), (0.8e0, 1.01e0)) v(lo, hi)
  ON {cond} GROUP BY 1, 2) x""")


CUTS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.8]


@query("confidence_tiers", TIER_COLS, _tiers(False))
def confidence_tiers(t):
    return E.confidence_tiers(t.preds(), ["model_id"], CUTS)


@query("confidence_bands", TIER_COLS, _tiers(True))
def confidence_bands(t):
    return E.confidence_tiers(t.preds(), ["model_id"], CUTS, banded=True)


@query("baselines", "season:b baseline:s games:b correct:b skipped:b accuracy:d wilson_low:d wilson_high:d", over("imp", f"""
 SELECT season, baseline, n AS games, k AS correct, skipped, k / NULLIF(CAST(n AS DOUBLE), 0) AS accuracy,
  CASE WHEN n > 0 THEN {wilson('k', 'NULLIF(n, 0)', '-')} END AS wilson_low, CASE WHEN n > 0 THEN {wilson('k', 'NULLIF(n, 0)', '+')} END AS wilson_high
 FROM (SELECT season, baseline, COUNT(CASE WHEN pick IS NOT NULL AND home_win IS NOT NULL THEN 1 END) AS n, COUNT(CASE WHEN pick = home_win THEN 1 END) AS k,
   COUNT(CASE WHEN pick IS NULL OR home_win IS NULL THEN 1 END) AS skipped
  FROM (SELECT season, home_win, 'home' AS baseline, 1 AS pick FROM imp UNION ALL SELECT season, home_win, 'moneyline', CASE WHEN ph > pa THEN 1 WHEN ph < pa THEN 0 END FROM imp
   UNION ALL SELECT season, home_win, 'spread', CASE WHEN spread_line > 0 THEN 1 WHEN spread_line < 0 THEN 0 END FROM imp) a GROUP BY 1, 2) x"""))
def baselines(t):
    ph, pa, s = implied_prob("home_ml"), implied_prob("away_ml"), F.col("spread_line")
    return E.baselines(t.odds(), {
        "home": F.lit(1), "moneyline": F.when(ph > pa, 1).when(ph < pa, 0), "spread": F.when(s > 0, 1).when(s < 0, 0)}, ["season"])


@query("noise_floor", "span:s n:b std_error:d detectable:d", over("games", " UNION ALL ".join(
    f"SELECT '{s}' AS span, COUNT(*) AS n, SQRT(0.67e0 * 0.33e0 / COUNT(*)) AS std_error, 1.959963984540054e0 * SQRT(2e0 * 0.67e0 * 0.33e0 / COUNT(*)) AS detectable "
    f"FROM games WHERE home_win IS NOT NULL AND season > (SELECT MAX(season) FROM games WHERE home_win IS NOT NULL) - {n}" for s, n in (("one", 1), ("three", 3), ("all", 100)))))
def noise_floor(t):
    return E.noise_floor(t.games(), 0.67, {"one": 1, "three": 3, "all": 100})


@query("compare_models", "a:s b:s diff:d threshold:d same:b", over("preds", """
 SELECT x.model_id AS a, y.model_id AS b, ABS(x.k / x.n - y.k / y.n) AS diff, thr AS threshold, CASE WHEN ABS(x.k / x.n - y.k / y.n) < thr THEN 1 ELSE 0 END AS same
 FROM tot x JOIN tot y ON x.model_id < y.model_id, LATERAL (SELECT 1.959963984540054e0 * SQRT((x.k + y.k) / (x.n + y.n) * (1e0 - (x.k + y.k) / (x.n + y.n)) * (1e0 / x.n + 1e0 / y.n)) AS thr) l""",
    tot=f"SELECT model_id, COUNT(*) AS n, SUM({hit()}) AS k FROM preds GROUP BY 1"))
def compare_models(t):
    return E.compare_models(t.preds(), MODELS)


@query("paired_diff", "n:b diff:d se:d low:d high:d", over("pw", f"""
 SELECT n, d AS diff, s AS se, d - 1.96e0 * s AS low, d + 1.96e0 * s AS high FROM (SELECT COUNT(*) AS n, AVG(x) AS d, STDDEV_SAMP(x) / SQRT(COUNT(*)) AS s
 FROM (SELECT {hit('p_form', 'home_win')} - {hit('p_market', 'home_win')} AS x FROM pw) a) b"""))
def paired_diff(t):
    return E.paired_diff(E.common_sample(t.preds(), MODELS), "form", "market")


SLICES_SQL = {"home_dog": "p < 0.5e0", "big_favourite": "GREATEST(p, 1e0 - p) >= 0.7e0", "close": "ABS(margin) <= 10", "even_id": "game_id % 2 = 0"}


def _slices():
    p = F.col("p")
    return {"home_dog": p < 0.5, "big_favourite": F.greatest(p, 1.0 - p) >= 0.7, "close": F.abs("margin") <= 10, "even_id": F.col("game_id") % 2 == 0}


@query("slice_metrics", "model_id:s slice:s n:b accuracy:d log_loss:d brier:d", over("preds", " UNION ALL ".join(
    f"SELECT model_id, '{k}' AS slice, {METRICS} FROM preds WHERE {c} GROUP BY model_id" for k, c in SLICES_SQL.items())))
def slice_metrics(t):
    return E.slice_metrics(t.preds(), _slices())


@query("slice_test", "slice:s n:b implied:d actual:d gap:d z:d p_value:d significant:b", over("preds", f"""
 SELECT *, CASE WHEN p_value < 0.05e0 / COUNT(*) OVER () THEN 1 ELSE 0 END AS significant FROM (SELECT *, 2e0 * (1e0 - {normal_cdf('ABS(z)')}) AS p_value
  FROM (SELECT *, actual - implied AS gap, (actual - implied) / SQRT(implied * (1e0 - implied) / n) AS z FROM s WHERE n >= 100) a) b""",
    s=" UNION ALL ".join(f"""SELECT '{k}' AS slice, COUNT(*) AS n, AVG(GREATEST(p, 1e0 - p)) AS implied, AVG(CASE WHEN p >= 0.5e0 THEN CAST(y AS DOUBLE) ELSE 1e0 - y END) AS actual
 FROM preds WHERE model_id = 'market' AND {c}""" for k, c in SLICES_SQL.items())))
def slice_test(t):
    return E.slice_test(t.preds().filter("model_id = 'market'"), _slices())


@query("disagreement", "misses:b flagged:d disagreements:b accuracy_when_differs:d", over("pw", """
 SELECT COUNT(CASE WHEN miss THEN 1 END) AS misses, AVG(CASE WHEN miss THEN CASE WHEN differ THEN 1e0 ELSE 0e0 END END) AS flagged, COUNT(CASE WHEN differ THEN 1 END) AS disagreements,
  AVG(CASE WHEN differ THEN CASE WHEN o = home_win THEN 1e0 ELSE 0e0 END END) AS accuracy_when_differs
 FROM (SELECT home_win, m <> home_win AS miss, m <> o AS differ, o FROM (SELECT home_win, CASE WHEN p_market >= 0.5e0 THEN 1 ELSE 0 END AS m, CASE WHEN p_form >= 0.5e0 THEN 1 ELSE 0 END AS o FROM pw) a) b"""))
def disagreement(t):
    return E.disagreement(E.common_sample(t.preds(), MODELS), "market", "form")


@query("roc_auc", "model_id:s positives:b negatives:b auc:d", over("preds", """
 SELECT model_id, SUM(y) AS positives, COUNT(*) - SUM(y) AS negatives, (SUM(CASE WHEN y = 1 THEN r END) - SUM(y) * (SUM(y) + 1) / 2e0) / (CAST(SUM(y) AS DOUBLE) * (COUNT(*) - SUM(y))) AS auc
 FROM (SELECT *, (RANK() OVER (PARTITION BY model_id ORDER BY p) + RANK() OVER (PARTITION BY model_id ORDER BY p) + COUNT(*) OVER (PARTITION BY model_id, p) - 1) / 2e0 AS r FROM preds) x GROUP BY 1"""))
def roc_auc(t):
    return Q.auc(t.preds(), ["model_id"])


@query("top_decile_lift", "model_id:s threshold:d n:b rate:d base:d lift:d", over("preds", """
 SELECT model_id, MAX(q) AS threshold, COUNT(CASE WHEN p >= q THEN 1 END) AS n, AVG(CASE WHEN p >= q THEN CAST(y AS DOUBLE) END) AS rate, AVG(CAST(y AS DOUBLE)) AS base,
  AVG(CASE WHEN p >= q THEN CAST(y AS DOUBLE) END) - AVG(CAST(y AS DOUBLE)) AS lift
 FROM preds JOIN (SELECT model_id, QUANTILE_CONT(p, 0.9) AS q FROM preds GROUP BY 1) t USING (model_id) GROUP BY 1"""))
def top_decile_lift(t):
    pred = t.preds()
    q = Q.exact_quantiles(pred, ["p"], [0.9], ["model_id"]).select("model_id", F.col("value").alias("q"))
    y, top = F.col("y").cast("double"), F.col("p") >= F.col("q")
    out = pred.join(q, "model_id").groupBy("model_id").agg(
        F.max("q").alias("threshold"), F.count(F.when(top, 1)).alias("n"), F.avg(F.when(top, y)).alias("rate"), F.avg(y).alias("base"))
    return out.withColumn("lift", F.col("rate") - F.col("base"))


@query("leakage_dates", "source:s rows_checked:b violations:b forbidden:s", over("elog", """
 SELECT 'max_source_date' AS source, COUNT(*) AS rows_checked, COUNT(CASE WHEN m >= game_date THEN 1 END) AS violations, 'opp_score,score' AS forbidden
 FROM (SELECT game_date, MAX(game_date) OVER (PARTITION BY entity ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m FROM elog) x"""))
def leakage_dates(t):
    from boutline.operators import history as H

    rows = H.with_running(t.log(), ["entity"], H.DAY, H.TIE, strict_day=True, running={"max_source_date": H.run_max(H.DAY)})
    return E.leakage_dates(rows, H.DAY, ["max_source_date"])


@query("lift_table", "model_id:s accuracy_lift:d log_loss_delta:d brier_delta:d", over("preds", """
 SELECT m.model_id, m.accuracy - b.accuracy AS accuracy_lift, m.log_loss - b.log_loss AS log_loss_delta, m.brier - b.brier AS brier_delta FROM m JOIN m b ON b.model_id = 'prior'""",
    m=f"SELECT model_id, {METRICS} FROM preds GROUP BY 1"))
def lift_table(t):
    return E.lift_table(E.score(t.preds()), "prior")


@query("slice_override", "model_id:s n:b accuracy:d log_loss:d brier:d", over("preds", f"""
 SELECT model_id, {METRICS} FROM (SELECT model_id, y, CASE WHEN ABS(p - 0.5e0) < 0.02e0 THEN 0.52e0 ELSE p END AS p FROM preds) x GROUP BY 1"""))
def slice_override(t):
    return E.score(E.slice_override(t.preds(), F.abs(F.col("p") - 0.5) < 0.02, F.lit(0.52)))


def _mixed(times):
    out = "((game_id % 2147483647) * 2654435761 + draw * 40503 + 12345) % 2147483647"
    for _ in range(times):
        out = f"(({out}) * 48271 + 11) % 2147483647"
    return out


POISSON = [sum(2.718281828459045 ** -1 / math.factorial(i) for i in range(k)) for k in range(1, 12)]


@query("block_bootstrap", "draws:b mean:d low:d high:d point:d", over("pw", f"""
 SELECT COUNT(*) AS draws, AVG(diff) AS mean, QUANTILE_CONT(diff, 0.025) AS low, QUANTILE_CONT(diff, 0.975) AS high, (SELECT SUM(d) / COUNT(*) FROM each) AS point
 FROM (SELECT draw, SUM(w * d) / SUM(w) AS diff FROM (SELECT draw, d, {' + '.join(f'CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END' for c in POISSON)} AS w
  FROM (SELECT draw, d, ({_mixed(3)}) / 2147483647e0 AS u FROM each CROSS JOIN range(200) r(draw)) x) y GROUP BY draw) z""",
    each=f"SELECT game_id, {log_loss('p_form', 'home_win')} - {log_loss('p_market', 'home_win')} AS d FROM pw"))
def block_bootstrap(t):
    return E.block_bootstrap(E.common_sample(t.preds(), MODELS), "form", "market", 200)


@query("permutation_check", "model_id:s accuracy:d draws:b mean_shuffled:d max_shuffled:d p_value:d")
def permutation_check(t):
    return E.permutation_check(t.preds(), 200, ["model_id"])


@query("robust_stats", "name:s median:d scale:d spread_scale:d", over("games", """
 SELECT name, med AS median, GREATEST((q3 - q1) / 1.349e0, 1e-6) AS scale, GREATEST((q3 - q1) / 1.349e0, sd * 0.5e0, 1e-6) AS spread_scale FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.5) AS med, QUANTILE_CONT({c}, 0.75) AS q3, STDDEV_POP({c}) AS sd FROM games" for c in ("margin", "home_score", "away_score")) + ") x"))
def robust_stats(t):
    cols = ["margin", "home_score", "away_score"]
    a = Q.robust_stats(t.games(), cols)
    b = Q.robust_stats(t.games(), cols, "spread").select("name", F.col("scale").alias("spread_scale"))
    return a.join(b, "name")
