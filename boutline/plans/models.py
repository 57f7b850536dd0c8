"""Fitted-model queries."""

from pyspark.sql import functions as F

from boutline.functions.features import numeric_columns
from boutline.functions.odds import logit, normal_wp
from boutline.operators import evaluate as E, grid as G, history as H, models as M
from boutline.operators.isotonic import apply_steps, fit_steps, on_grid
from boutline.plans.evaluation import MODELS
from boutline.plans.history import FORM
from boutline.plans.modelling import MU, SIGMA, seasons
from boutline.plans.oracle import over
from boutline.plans.registry import query
from boutline.session import scratch_path, stored

STEMS = ["season_pct", "season_gd", "last10_pct", "home_pct"]
COLUMNS = [f"delta_{s}" for s in STEMS]
#: Sizes that the queries fit; the operator's own default is 120.
TREES = {"boosted": 8, "bagged": 12}


def _table(t):
    """Pregame feature table, written once because every fold reads it."""
    rows = H.pivot_sides(H.form_features(t.log()), ["game_id", "season", "game_date"], STEMS)
    y = t.games().filter("home_win is not null").select("game_id", F.col("home_win").alias("y"), "margin")
    return stored(rows.join(y, "game_id"), "features")


def _wide(t):
    return stored(E.common_sample(t.preds(), MODELS), "preds")


@query("prepared_features", "game_id:b season:b delta_season_pct:d delta_season_gd:d", over("elog", """
 SELECT f.game_id, f.season, (COALESCE(f.p, s.pm) - s.pa) / s.ps AS delta_season_pct, (COALESCE(f.g, s.gm) - s.ga) / s.gs AS delta_season_gd FROM f CROSS JOIN s WHERE f.season >= 2000""", form=FORM,
    f="SELECT h.game_id, h.season, h.season_pct - a.season_pct AS p, h.season_gd - a.season_gd AS g FROM form h JOIN form a ON a.game_id = h.game_id AND h.is_home = 1 AND a.is_home = 0",
    m="SELECT QUANTILE_CONT(p, 0.5) AS pm, QUANTILE_CONT(g, 0.5) AS gm FROM f WHERE season < 2000",
    s="SELECT pm, gm, AVG(COALESCE(p, pm)) AS pa, STDDEV_POP(COALESCE(p, pm)) AS ps, AVG(COALESCE(g, gm)) AS ga, STDDEV_POP(COALESCE(g, gm)) AS gs FROM f CROSS JOIN m WHERE season < 2000 GROUP BY 1, 2"))
def prepared_features(t):
    d = _table(t)
    return M.prep(d.filter("season < 2000"), d.filter("season >= 2000"), ["delta_season_pct", "delta_season_gd"])[1]


SCORES = "season:b n:b accuracy:d log_loss:d brier:d"


@query("walk_forward_logistic", SCORES)
def walk_forward_logistic(t):
    rows = H.recency_weights(t.games(), 2.0, 5000.0, 0.05).select("game_id", "weight")
    d = stored(_table(t).join(rows, "game_id"), "weighted")
    p = M.walk_forward(d, COLUMNS, "y", seasons(d), lambda n: M.logistic(COLUMNS, "y", 1.0 / (0.25 * n), "weight"), 4)
    return E.score(p, ["season"])


#: The settings that are tried: descents as long as with rates of 0.02, 0.03 and 0.05 and 250, 350 and 450 steps, in a fifth of the steps.
GRID = G.Grid((0.10, 0.15, 0.25), (0.01, 0.03, 0.08, 0.15, 0.30), (50, 70, 90))
#: The one taken where nothing can be compared.
USUAL = (0.15, 0.08, 70)


@query("logistic_grid", "season:b rate:d penalty:d epochs:b n:b log_loss:d accuracy:d slope:d chosen:b")
def logistic_grid(t):
    rows = H.recency_weights(t.games(), 2.0, 5000.0, 0.05).select("game_id", "weight")
    d = stored(_table(t).join(rows, "game_id"), "weighted")
    fits = G.fit_grid(d, COLUMNS, "y", seasons(d)[2:], GRID, "weight")
    return G.choose_setting(G.score_grid(d, fits, "y"), USUAL)


@query("walk_forward_boosted", SCORES)
def walk_forward_boosted(t):
    d = _table(t)
    return E.score(M.walk_forward(d, COLUMNS, "y", seasons(d), lambda n: M.trees(COLUMNS, "y", size=TREES["boosted"]), 5), ["season"])


@query("walk_forward_bagged", SCORES)
def walk_forward_bagged(t):
    d = _table(t)
    return E.score(M.walk_forward(d, COLUMNS, "y", seasons(d), lambda n: M.trees(COLUMNS, "y", "bagged", size=TREES["bagged"]), 5), ["season"])


@query("calibrators", "model_id:s method:s n:b accuracy:d log_loss:d brier:d")
def calibrators(t):
    p = stored(t.preds().withColumn("w", 1.0 + (F.col("season") - 1995) / 10.0), "preds")
    a, b = p.filter("season < 2000"), p.filter("season >= 2000")
    parts = [("isotonic", M.isotonic(a, b, weight="w", by=["model_id"]))]  # all models in one fit
    for model in MODELS:  # a fixed list: two fits for each model
        own, asked = (df.filter(F.col("model_id") == model) for df in (a, b))
        parts += [("platt", M.platt(own, asked, weight="w")), ("beta", M.beta_calibration(own, asked))]
    out = None
    for name, df in parts:
        s = df.select("model_id", F.lit(name).alias("method"), "y", F.col("calibrated").alias("p"))
        out = s if out is None else out.unionByName(s)
    return E.score(out, ["model_id", "method"])


# The greatest, over starts at or below a score, of the least mean, over ends at or above it.
@query("isotonic_steps", "model_id:s score:d n:b value:d", over("preds", """
 SELECT model_id, x AS score, n, fitted AS value FROM (
  SELECT e.model_id, e.x, e.n, MAX(m.least) AS fitted FROM points e JOIN ends m ON m.model_id = e.model_id AND m.j = e.i GROUP BY 1, 2, 3) f""",
    points="SELECT model_id, x, n, ROW_NUMBER() OVER w AS i, SUM(sy) OVER w AS cy, SUM(sw) OVER w AS cw, sy, sw FROM (SELECT model_id, FLOOR(p * 1e3 + 0.5000001e0) / 1e3 AS x, COUNT(*) AS n, SUM(y * (1 + (season - 1995) / 10e0)) AS sy, SUM(1 + (season - 1995) / 10e0) AS sw FROM preds GROUP BY 1, 2) g WINDOW w AS (PARTITION BY model_id ORDER BY x)",
    ends="SELECT a.model_id, a.i, b.i AS j, MIN((b.cy - a.cy + a.sy) / (b.cw - a.cw + a.sw)) OVER (PARTITION BY a.model_id, a.i ORDER BY b.i DESC) AS least FROM points a JOIN points b ON b.model_id = a.model_id AND b.i >= a.i"))
def isotonic_steps(t):
    p = stored(t.preds().withColumn("w", 1.0 + (F.col("season") - 1995) / 10.0), "preds")
    steps = stored(fit_steps(p, ["model_id"], weight="w", digits=3), "steps")
    scores = p.groupBy("model_id", on_grid(F.col("p"), 3).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return apply_steps(scores, steps, ["model_id"], "score", "value", 3)


@query("stacking", "method:s n:b accuracy:d log_loss:d brier:d")
def stacking(t):
    w = _wide(t)
    a, b = w.filter("season < 2000"), w.filter("season >= 2000")
    out = None
    for name, icpt in (("stack", True), ("stack_no_intercept", False)):
        s = M.stack(a, b, MODELS, intercept=icpt).select(F.lit(name).alias("method"), "y", F.col("stacked").alias("p"))
        out = s if out is None else out.unionByName(s)
    return E.score(out.unionByName(b.select(F.lit("vote").alias("method"), "y", M.vote(MODELS).alias("p"))), ["method"])


@query("kfold_stack", "n:b accuracy:d log_loss:d brier:d")
def kfold_stack(t):
    d = _table(t).fillna(0.0)
    return E.score(M.kfold_stack(d, {"season": COLUMNS[:2], "recent": COLUMNS[2:]}, "y").withColumn("p", F.col("stacked")), [])


@query("permutation_importance", "feature:s importance:d accuracy:d")
def permutation_importance(t):
    d = _table(t)
    a, b = M.prep(d.filter("season < 2000"), d.filter("season >= 2000"), COLUMNS)
    return M.permutation_importance(M.logistic(COLUMNS, "y", 1e-3).fit(a), b, COLUMNS, "y")


@query("top_weights", "feature:s weight:d")
def top_weights(t):
    d = _table(t)
    a, _ = M.prep(d.filter("season < 2000"), d.filter("season >= 2000"), COLUMNS)
    return M.coefficients(M.logistic(COLUMNS, "y", 1e-3).fit(a), COLUMNS, 3)


@query("score_batch", "game_id:b p:d pick_home:b")
def score_batch(t):
    d = _table(t).fillna(0.0)
    path = scratch_path(t.spark, "model")
    names = [c for c in numeric_columns(d, ["game_id", "season", "home", "away", "y", "margin"], market=False) if c.startswith("delta_")]
    M.logistic(names, "y", 1e-3).fit(d.filter("season < 2000")).save(path)
    return M.score_batch(path, d.filter("season >= 2000"), (0.15, 0.85))


@query("leakage_r2", "n:b r2:d exact_rate:d")
def leakage_r2(t):
    d = _table(t)
    return M.leakage_r2(d.filter("season < 2000"), d.filter("season >= 2000"), COLUMNS, "margin")


@query("poly_correction", "n:b accuracy:d log_loss:d brier:d")
def poly_correction(t):
    s = t.states().filter("home_won is not null").withColumn("base", normal_wp("margin", "frac", MU, SIGMA))
    s = s.withColumns({"z": logit("base"), "m": F.col("margin").cast("double"), "scaled": F.col("margin") / F.sqrt(F.col("frac") + 1e-6)})
    s = stored(s.select("game_id", "home_won", "base", "z", "m", "scaled", "frac"), "states")
    out = M.poly_correction(s.filter("game_id % 5 < 4"), s.filter("game_id % 5 = 4"), ["z", "m", "frac"], "home_won")
    return E.score(out.select(F.col("home_won").alias("y"), (0.6 * F.col("corrected") + 0.4 * F.col("base")).alias("p")), [])
