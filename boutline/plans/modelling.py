"""Fold, calibration, blend and in-contest state queries."""

from pyspark.sql import functions as F

from boutline.functions.odds import normal_wp, sigmoid, logit
from boutline.operators import evaluate as E, folds as M, history as H, states as X
from boutline.plans.evaluation import METRICS, MODELS, normal_cdf
from boutline.plans.oracle import hit, log_loss, over
from boutline.plans.registry import query
from boutline.session import stored

PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _folds_sql(frame, least):
    return over("games", f"""SELECT * FROM (SELECT season AS test_season, n AS test_games, COUNT(*) OVER w AS train_seasons, MIN(season) OVER w AS train_start, MAX(season) OVER w AS train_end,
 COALESCE(SUM(n) OVER w, 0) AS train_games, CASE WHEN ROW_NUMBER() OVER (ORDER BY season DESC) <= 2 THEN 1 ELSE 0 END AS is_holdout
 FROM (SELECT season, COUNT(*) AS n FROM games GROUP BY 1) s WINDOW w AS (ORDER BY season {frame})) x WHERE train_seasons >= {least}""")


FOLDS = "test_season:b test_games:b train_seasons:b train_start:b train_end:b train_games:b is_holdout:b"


@query("walk_forward_folds", FOLDS, _folds_sql(PAST, 3))
def walk_forward_folds(t):
    return M.walk_forward_folds(t.games(), 3, holdout=2)


@query("sliding_folds", FOLDS, _folds_sql("ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING", 2))
def sliding_folds(t):
    return M.walk_forward_folds(t.games(), 2, holdout=2, span=2)


@query("chronological_split", "game_id:b position:b part:s", over("games", """
 SELECT game_id, rn AS position, CASE WHEN rn <= FLOOR(n * 0.7e0) THEN 'fit' WHEN rn <= FLOOR(n * 0.8e0) THEN 'calibration' ELSE 'validation' END AS part
 FROM (SELECT game_id, ROW_NUMBER() OVER (ORDER BY game_date, game_id) AS rn, COUNT(*) OVER () AS n FROM games) x"""))
def chronological_split(t):
    return M.split_by_game(t.games(), [("fit", 0.7), ("calibration", 0.8), ("validation", 1.0)])


@query("stratified_split", "game_id:b home_win:b part:s", over("games", """
 SELECT game_id, home_win, CASE WHEN rn <= FLOOR(n * 0.2e0) THEN 'validation' ELSE 'fit' END AS part
 FROM (SELECT game_id, home_win, ROW_NUMBER() OVER (PARTITION BY home_win ORDER BY MD5(CAST(game_id AS VARCHAR)), game_id) AS rn, COUNT(*) OVER (PARTITION BY home_win) AS n FROM games WHERE home_win IS NOT NULL) x"""))
def stratified_split(t):
    return M.split_stratified(t.games().filter("home_win is not null"), "home_win", 0.2)


def seasons(games):
    """The seasons there are, in order: a handful of numbers."""
    return [r.season for r in games.select("season").distinct().orderBy("season").collect()]


@query("fold_overlap", "part:s season:b games:b shared:b", over("games", """
 SELECT part, season, COUNT(*) AS games, (SELECT COUNT(*) FROM (SELECT game_id FROM s WHERE part = 'train' INTERSECT SELECT game_id FROM s WHERE part = 'test') b) AS shared FROM s GROUP BY 1, 2""",
    x="SELECT game_id, season, ROW_NUMBER() OVER (ORDER BY game_date, game_id) <= FLOOR(COUNT(*) OVER () * 0.8e0) AS early FROM games",
    s="SELECT game_id, season, CASE WHEN early THEN 'train' ELSE 'test' END AS part FROM x UNION ALL SELECT game_id, season, 'test' FROM x WHERE early AND game_id % 50 = 0"))
def fold_overlap(t):
    s = M.split_by_game(t.games(), [("train", 0.8), ("test", 1.0)]).select("game_id", "season", "part")
    # An overlap made on purpose: the check has to count it.
    s = s.unionByName(s.filter("part = 'train' and game_id % 50 = 0").withColumn("part", F.lit("test")))
    both = s.filter("part = 'train'").select("game_id").intersect(s.filter("part = 'test'").select("game_id")).agg(F.count(F.lit(1)).alias("shared"))
    return M.attach_row(s.groupBy("part", "season").agg(F.count(F.lit(1)).alias("games")), both)


@query("fold_robust_scale", "game_id:b season:b margin_scaled:d home_score_scaled:d", over("games", "SELECT g.game_id, g.season, " + ", ".join(
    f"GREATEST(-6e0, LEAST(6e0, (g.{c} - s.{c}_m) / GREATEST((s.{c}_b - s.{c}_a) / 1.349e0, 1e-6))) AS {c}_scaled" for c in ("margin", "home_score"))
    + " FROM games g JOIN s ON s.season = g.season",
    s="SELECT f.season, " + ", ".join(f"QUANTILE_CONT(g.{c}, 0.25) AS {c}_a, QUANTILE_CONT(g.{c}, 0.5) AS {c}_m, QUANTILE_CONT(g.{c}, 0.75) AS {c}_b" for c in ("margin", "home_score"))
      + " FROM (SELECT DISTINCT season FROM games) f JOIN games g ON g.season < f.season GROUP BY 1"))
def fold_robust_scale(t):
    games = t.games()
    return M.robust_scale(games, ["margin", "home_score"], seasons(games))


@query("histogram_binning", "model_id:s season:b game_id:b p:d calibrated:d", over("preds", f"""
 SELECT p.model_id, p.season, p.game_id, p.p, COALESCE(c.r, 0.5e0) AS calibrated FROM preds p LEFT JOIN
 (SELECT f.model_id, f.season, f.bin, CAST(SUM(c.k) AS DOUBLE) / SUM(c.n) AS r FROM (SELECT DISTINCT model_id, season, b.bin FROM preds CROSS JOIN range(10) b(bin)) f
  JOIN (SELECT model_id, season, LEAST(FLOOR(p * 10), 9) AS bin, SUM(y) AS k, COUNT(*) AS n FROM preds GROUP BY 1, 2, 3) c ON c.model_id = f.model_id AND c.bin = f.bin AND c.season < f.season GROUP BY 1, 2, 3) c
 ON c.model_id = p.model_id AND c.season = p.season AND c.bin = LEAST(FLOOR(p.p * 10), 9)"""))
def histogram_binning(t):
    return M.histogram_binning(t.preds())


@query("grouped_calibration", "model_id:s game_id:b p:d calibrated:d key_rows:b", over("preds", """
 SELECT t.model_id, t.game_id, t.p, k.n AS key_rows, CASE WHEN k.n IS NOT NULL THEN COALESCE(c.r, 0.5e0) ELSE COALESCE(w.r, 0.5e0) END AS calibrated
 FROM (SELECT *, LEAST(FLOOR(p * 10), 9) AS bin FROM preds WHERE season >= 2000) t
 LEFT JOIN (SELECT model_id, home, COUNT(*) AS n FROM tr GROUP BY 1, 2 HAVING COUNT(*) >= 80) k ON k.model_id = t.model_id AND k.home = t.home
 LEFT JOIN (SELECT model_id, home, bin, AVG(CAST(y AS DOUBLE)) AS r FROM tr GROUP BY 1, 2, 3) c ON c.model_id = t.model_id AND c.home = t.home AND c.bin = t.bin
 LEFT JOIN (SELECT model_id, bin, AVG(CAST(y AS DOUBLE)) AS r FROM tr GROUP BY 1, 2) w ON w.model_id = t.model_id AND w.bin = t.bin""",
    tr="SELECT *, LEAST(FLOOR(p * 10), 9) AS bin FROM preds WHERE season < 2000"))
def grouped_calibration(t):
    p = t.preds()
    return M.grouped_calibration(p.filter("season < 2000"), p.filter("season >= 2000"), "home", min_rows=80, by=["model_id"])


def _temp_loss(p, temp):
    return log_loss(f"(1e0 / (1e0 + EXP(-LN(({p}) / (1e0 - ({p}))) / {temp})))")


@query("temperature_scaling", "model_id:s temperature:d loss:d", over("preds", f"""
 SELECT model_id, temp AS temperature, loss FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY loss, temp) AS r FROM
 (SELECT p.model_id, ROUND(c.temp + j / 100e0, 2) AS temp, AVG({_temp_loss('p.p', 'ROUND(c.temp + j / 100e0, 2)')}) AS loss FROM preds p JOIN c ON c.model_id = p.model_id CROSS JOIN range(-10, 11) s(j)
  WHERE ROUND(c.temp + j / 100e0, 2) BETWEEN 0.1e0 AND 3e0 GROUP BY 1, 2) a) b WHERE r = 1""",
    c=f"""SELECT model_id, temp FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY loss, temp) AS r FROM
 (SELECT model_id, ROUND(i / 10e0, 2) AS temp, AVG({_temp_loss('p', 'ROUND(i / 10e0, 2)')}) AS loss FROM preds CROSS JOIN range(1, 31) s(i) GROUP BY 1, 2) a) b WHERE r = 1"""))
def temperature_scaling(t):
    return M.temperature(t.preds())


BLENDS = [("b50", 0.5, 0.5), ("b55", 0.55, 0.45), ("b60", 0.6, 0.4), ("b65", 0.65, 0.35), ("b70", 0.7, 0.3)]
SUMS = "SUM({ll}) AS ll, SUM((q - y) * (q - y)) AS br, SUM({ok}) AS ok, COUNT(*) AS n".format(ll=log_loss("q"), ok=hit("q"))


@query("validated_blend", "season:b game_id:b blend_id:s p:d", over("pw", f"""
 SELECT w.season, w.game_id, k.blend_id, (v.a * p_form + v.b * p_market) / (v.a + v.b) AS p FROM pw w JOIN k ON k.season = w.season JOIN v ON v.blend_id = k.blend_id""",
    v="SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}e0, {b}e0)" for i, a, b in BLENDS) + ") t(blend_id, a, b)",
    s=f"SELECT season, blend_id, {SUMS} FROM (SELECT season, blend_id, home_win AS y, (a * p_form + b * p_market) / (a + b) AS q FROM pw CROSS JOIN v) x GROUP BY 1, 2",
    c=f"SELECT season, blend_id, SUM(ll) OVER w / SUM(n) OVER w AS ll, SUM(br) OVER w / SUM(n) OVER w AS br, SUM(ok) OVER w / SUM(n) OVER w AS acc FROM s WINDOW w AS (PARTITION BY blend_id ORDER BY season {PAST})",
    k="SELECT season, CASE WHEN ll IS NULL THEN 'b50' ELSE blend_id END AS blend_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY ll, br, -acc, blend_id) AS r FROM c) x WHERE r = 1"))
def validated_blend(t):
    wide = E.common_sample(t.preds(), MODELS)
    return M.blend(wide, [{"blend_id": i, "w_form": a, "w_market": b} for i, a, b in BLENDS], "b50")


@query("regime_blend", "season:b game_id:b regime:s blend_id:s p:d", over("pw", """
 SELECT w.season, w.game_id, w.regime, k.blend_id, COALESCE(v.a, 0.4e0) * p_form + COALESCE(v.b, 0.4e0) * p_market + COALESCE(v.c, 0.2e0) * p_prior AS p
 FROM z w JOIN k ON k.season = w.season AND k.stage = w.stage LEFT JOIN v ON v.blend_id = k.blend_id""",
    z="""SELECT *, CASE regime WHEN 'early' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS stage FROM (SELECT *, CASE WHEN rn <= n / 3e0 THEN 'early' WHEN rn / CAST(n AS DOUBLE) <= 2e0 / 3 THEN 'mid' ELSE 'late' END AS regime FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date, game_id) AS rn, COUNT(*) OVER (PARTITION BY season) AS n FROM pw) a) b""",
    v="""SELECT LPAD(CAST(i AS VARCHAR), 2, '0') || '-' || LPAD(CAST(j AS VARCHAR), 2, '0') || '-' || LPAD(CAST(5 - i - j AS VARCHAR), 2, '0') AS blend_id, i / 5e0 AS a, j / 5e0 AS b, (5 - i - j) / 5e0 AS c
 FROM range(6) x(i) CROSS JOIN range(6) y(j) WHERE i + j <= 5""",
    s=f"SELECT season, stage, blend_id, {SUMS} FROM (SELECT season, stage, blend_id, home_win AS y, a * p_form + b * p_market + c * p_prior AS q FROM z CROSS JOIN v) x GROUP BY 1, 2, 3",
    tr="""SELECT f.season, f.stage, s.blend_id, SUM(s.ll) / SUM(s.n) AS ll, SUM(s.br) / SUM(s.n) AS br, SUM(s.ok) / SUM(s.n) AS acc FROM (SELECT DISTINCT season, stage FROM z) f
 JOIN s ON (s.season < f.season AND s.stage <= f.stage) OR (s.season = f.season AND s.stage < f.stage) GROUP BY 1, 2, 3""",
    k="""SELECT f.season, f.stage, r.blend_id FROM (SELECT DISTINCT season, stage FROM z) f LEFT JOIN
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY season, stage ORDER BY -acc, ll, br, blend_id) AS r FROM tr) r ON r.season = f.season AND r.stage = f.stage AND r.r = 1"""))
def regime_blend(t):
    wide = E.common_sample(t.preds(), MODELS)
    r = H.regime(t.games().filter("home_win is not null")).select("game_id", "regime")
    return M.regime_blend(wide.join(r, "game_id"), MODELS, 0.2, {"form": 0.4, "market": 0.4, "prior": 0.2})


@query("logit_average", "season:b weight:d train_games:b", over("pw", f"""
 SELECT season, weight, past_n AS train_games FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY ll, -acc, weight) AS r FROM c WHERE past_n IS NOT NULL) x WHERE r = 1""",
    s=f"""SELECT season, weight, {SUMS} FROM (SELECT season, weight, home_win AS y, 1e0 / (1e0 + EXP(-((1 - weight) * LN(p_form / (1 - p_form)) + weight * LN(p_market / (1 - p_market))))) AS q
 FROM pw CROSS JOIN (SELECT ROUND(-0.5e0 + 0.025e0 * i, 3) AS weight FROM range(81) g(i)) h) x GROUP BY 1, 2""",
    c=f"SELECT season, weight, SUM(n) OVER w AS past_n, SUM(ll) OVER w / SUM(n) OVER w AS ll, SUM(ok) OVER w / SUM(n) OVER w AS acc FROM s WINDOW w AS (PARTITION BY weight ORDER BY season {PAST})"))
def logit_average(t):
    return M.average_weight(E.common_sample(t.preds(), MODELS), "form", "market")


@query("choose_calibrator", "method:s best_method:s objective:d", over("preds", """
 SELECT CASE WHEN kept - k1 <= 0.02e0 THEN 'prior' ELSE method END AS method, method AS best_method, k1 AS objective FROM (SELECT method, 0.5e0 * ll + 0.5e0 * br AS k1, MAX(CASE WHEN method = 'prior' THEN 0.5e0 * ll + 0.5e0 * br END) OVER () AS kept,
  ROW_NUMBER() OVER (ORDER BY 0.5e0 * ll + 0.5e0 * br, ll, -acc, method) AS r FROM m) x WHERE r = 1""",
    m=f"""SELECT method, SUM(weight * log_loss) / SUM(weight) AS ll, SUM(weight * brier) / SUM(weight) AS br, SUM(weight * accuracy) / SUM(weight) AS acc FROM
 (SELECT model_id AS method, season - 1994 AS weight, {METRICS} FROM preds GROUP BY 1, 2) v GROUP BY 1"""))
def choose_calibrator(t):
    views = E.score(t.preds(), ["model_id", "season"]).select(F.col("model_id").alias("method"), (F.col("season") - 1994).alias("weight"), "accuracy", "log_loss", "brier")
    return M.choose_calibrator(views, "joint", 0.02, "prior")


@query("select_config", "season:b model_id:s complexity:b accuracy:d log_loss:d", over("preds", f"""
 SELECT season, model_id, complexity, accuracy, log_loss FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY complexity, log_loss, -accuracy, model_id) AS r FROM
 (SELECT *, MAX(accuracy) OVER (PARTITION BY season) AS top FROM m) x WHERE accuracy >= top - 0.01e0) y WHERE r = 1""",
    m=f"SELECT season, model_id, CASE model_id WHEN 'prior' THEN 1 WHEN 'form' THEN 2 ELSE 3 END AS complexity, {METRICS} FROM preds GROUP BY 1, 2"))
def select_config(t):
    m = E.score(t.preds(), ["season", "model_id"]).withColumn("complexity", F.when(F.col("model_id") == "prior", 1).when(F.col("model_id") == "form", 2).otherwise(3))
    return M.select_config(m, ["season"])


@query("weighted_score", "game_id:b p:d", over("pw", """
 SELECT game_id, 1e0 / (1e0 + EXP(-(1.2e0 * LN(p_form / (1 - p_form)) - 0.3e0 * LN(p_prior / (1 - p_prior)) + 0.5e0 * (spread_line)) / 2e0)) AS p FROM pw"""))
def weighted_score(t):
    rows = t.preds_wide().withColumns({"lf": logit("p_form"), "lp": logit("p_prior")})
    return rows.withColumn("p", sigmoid(M.weighted_score(rows, {"lf": 1.2, "lp": -0.3, "spread_line": 0.5})))


@query("recency_grid", "mode:s season_hl:d game_hl:d floor_w:d n:b mean_weight:d effective_n:d", over("games", """
 SELECT mode, season_hl, game_hl, floor_w, COUNT(*) AS n, AVG(w) AS mean_weight, SUM(w) * SUM(w) / SUM(w * w) AS effective_n FROM (SELECT *, GREATEST(floor_w, CASE mode WHEN 'season' THEN s WHEN 'game' THEN g WHEN 'hybrid' THEN s * g ELSE 1e0 END) AS w FROM
 (SELECT *, POWER(0.5e0, sa / season_hl) AS s, POWER(0.5e0, ga / game_hl) AS g FROM (SELECT DENSE_RANK() OVER (ORDER BY season DESC) - 1 AS sa, COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY game_date, game_id) AS ga FROM games) a
  CROSS JOIN (VALUES ('none'), ('season'), ('game'), ('hybrid')) m(mode) CROSS JOIN (VALUES (1.5e0), (3e0)) h(season_hl) CROSS JOIN (VALUES (2000e0), (8000e0)) i(game_hl) CROSS JOIN (VALUES (0.05e0), (0.2e0)) f(floor_w)) b) c GROUP BY 1, 2, 3, 4"""))
def recency_grid(t):
    return M.recency_grid(t.games(), ["none", "season", "game", "hybrid"], [1.5, 3.0], [2000.0, 8000.0], [0.05, 0.2])


# ---------------------------------------------------------------- in-contest states

LO, HI, MU, SIGMA, ALPHA, POWER = -25, 25, 0.5, 8.0, 0.6, 0.5


def _wp(m, f, mu="0.5e0", sigma="8e0"):
    return f"CASE WHEN {f} <= 1e-6 THEN CASE WHEN {m} > 0 THEN 1e0 WHEN {m} < 0 THEN 0e0 ELSE 0.5e0 END ELSE {normal_cdf(f'({m} + {mu} * {f}) / GREATEST(1e-6, {sigma} * SQRT({f}))')} END"


@query("normal_wp", "event_id:b p:d leader:d ll:d br:d", over("states", f"""
 SELECT event_id, p, CASE WHEN margin > 0 THEN 0.85e0 WHEN margin < 0 THEN 0.15e0 ELSE 0.5e0 END AS leader, {log_loss('p', 'home_won')} AS ll, (p - home_won) * (p - home_won) AS br
 FROM (SELECT *, {_wp('margin', 'frac')} AS p FROM states) x"""))
def normal_wp_query(t):
    from boutline.functions.odds import brier as br, log_loss as ll

    s = t.states().withColumn("p", normal_wp("margin", "frac", MU, SIGMA))
    return s.withColumns({"leader": F.when(F.col("margin") > 0, 0.85).when(F.col("margin") < 0, 0.15).otherwise(0.5),
                          "ll": ll("p", "home_won"), "br": br("p", "home_won")})


@query("ols_normal_wp", "mu:d sigma:d n:b", over("states", """
 SELECT mu, SQRT(AVG(POWER(final_margin - margin - mu * frac, 2) / frac)) AS sigma, COUNT(*) AS n FROM states, (SELECT SUM(frac * (final_margin - margin)) / SUM(frac * frac) AS mu FROM states WHERE frac > 1e-6) x WHERE frac > 1e-6 GROUP BY mu"""))
def ols_normal_wp(t):
    return X.ols_normal_wp(t.states())


@query("fit_normal_wp", "mu:d sigma:d")
def fit_normal_wp(t):
    mu, sigma = X.fit_normal_wp(t.states())
    return t.spark.range(1).select(F.lit(mu).alias("mu"), F.lit(sigma).alias("sigma"))


@query("fit_normal_wp_brier", "mu:d sigma:d")
def fit_normal_wp_brier(t):
    mu, sigma = X.fit_normal_wp(t.states(), "brier")
    return t.spark.range(1).select(F.lit(mu).alias("mu"), F.lit(sigma).alias("sigma"))


SURFACE = dict(
    cells="""SELECT GREATEST(-25, LEAST(25, margin)) AS margin, CAST(FLOOR(frac * 40 + 0.5e0) AS INT) AS j, SUM(home_won) AS k, COUNT(*) AS n FROM states WHERE home_won IS NOT NULL GROUP BY 1, 2""",
    g=f"SELECT m AS margin, j, j / 40e0 AS frac, {_wp('m', '(j / 40e0)')} AS q FROM range(-25, 26) a(m) CROSS JOIN range(41) b(j)",
    raw="""SELECT g.margin, g.j, g.frac, (1e0 - 0.6e0 * SQRT(g.frac)) * ((COALESCE(c.k, 0) + 2e0 * q) / (COALESCE(c.n, 0) + 2e0)) + 0.6e0 * SQRT(g.frac) * q AS p FROM g LEFT JOIN cells c ON c.margin = g.margin AND c.j = g.j""",
    surf="""SELECT margin, j, frac, p, p_time, MAX(p_time) OVER (PARTITION BY j ORDER BY margin) AS p_mono FROM (SELECT *, CASE WHEN margin > 0 THEN MAX(p) OVER w WHEN margin < 0 THEN MIN(p) OVER w ELSE p END AS p_time FROM raw WINDOW w AS (PARTITION BY margin ORDER BY j DESC)) x""")


def _surface(t):
    return X.monotone_surface(X.raw_surface(t.states(), (LO, HI), MU, SIGMA, ALPHA, POWER))


@query("monotone_surface", "margin:b j:b frac:d p:d p_time:d p_mono:d", over("states", "SELECT * FROM surf", **SURFACE))
def monotone_surface(t):
    return _surface(t)


@query("surface_scores", "event_id:b step_p:d linear_p:d", over("states", """
 SELECT event_id, u.p_mono AS step_p, d.p_mono + (u.p_mono - d.p_mono) * GREATEST(0e0, frac * 40 - x.jd) AS linear_p
 FROM (SELECT *, CAST(LEAST(40, GREATEST(0, CEIL(frac * 40 - 1e-9))) AS INT) AS ju, CAST(GREATEST(0, FLOOR(frac * 40 + 1e-9)) AS INT) AS jd, GREATEST(-25, LEAST(25, margin)) AS cm FROM states) x
 JOIN (SELECT margin AS um, j AS uj, p_mono FROM surf) u ON u.um = x.cm AND u.uj = x.ju JOIN (SELECT margin AS dm, j AS dj, p_mono FROM surf) d ON d.dm = x.cm AND d.dj = x.jd""", **SURFACE))
def surface_scores(t):
    s = _surface(t)
    rows = X.surface_score(t.states(), s, (LO, HI), name="step_p")
    return X.surface_score(rows, s, (LO, HI), linear=True, name="linear_p")


@query("monotone_audit", "margin:b time_drops:b margin_drops:b worst:d", over("states", """
 SELECT margin, COUNT(CASE WHEN wrong > 1e-9 THEN 1 END) AS time_drops, COUNT(CASE WHEN dm < -1e-9 THEN 1 END) AS margin_drops, COALESCE(MAX(CASE WHEN wrong > 1e-9 THEN wrong END), 0) AS worst
 FROM (SELECT *, CASE WHEN margin > 0 THEN -dt WHEN margin < 0 THEN dt END AS wrong FROM (SELECT margin, p - LAG(p) OVER (PARTITION BY margin ORDER BY i) AS dt, p - LAG(p) OVER (PARTITION BY i ORDER BY margin) AS dm
  FROM (SELECT a.m AS margin, b.i, s.p_mono AS p FROM range(-25, 26) a(m) CROSS JOIN range(401) b(i) JOIN surf s ON s.margin = a.m AND s.j = CAST(GREATEST(0, CEIL((1e0 - i / 400e0) * 40 - 1e-9)) AS INT)) x) y) z GROUP BY 1""", **SURFACE))
def monotone_audit(t):
    return X.monotone_audit(_surface(t), (LO, HI))


def _gate_sql(v):
    """Audit flags and scores of one surface."""
    steps = f"""SELECT CASE WHEN margin > 0 THEN -dt WHEN margin < 0 THEN dt END AS wrong, dm FROM (SELECT margin, p - LAG(p) OVER (PARTITION BY margin ORDER BY i) AS dt, p - LAG(p) OVER (PARTITION BY i ORDER BY margin) AS dm
  FROM (SELECT a.m AS margin, b.i, s.{v} AS p FROM range(-25, 26) a(m) CROSS JOIN range(401) b(i) JOIN surf s ON s.margin = a.m AND s.j = CAST(GREATEST(0, CEIL((1e0 - i / 400e0) * 40 - 1e-9)) AS INT)) x) y"""
    scored = f"SELECT s.{v} AS p, home_won AS y FROM states t JOIN surf s ON s.margin = GREATEST(-25, LEAST(25, t.margin)) AND s.j = CAST(LEAST(40, GREATEST(0, CEIL(t.frac * 40 - 1e-9))) AS INT) WHERE home_won IS NOT NULL"
    return f"""SELECT '{v}' AS model_id, log_loss, brier, margin_ok, time_ok FROM (SELECT AVG({log_loss()}) AS log_loss, AVG((p - y) * (p - y)) AS brier FROM ({scored}) a) b,
 (SELECT CASE WHEN COUNT(CASE WHEN dm < -1e-9 THEN 1 END) = 0 THEN 1 ELSE 0 END AS margin_ok, CASE WHEN COUNT(CASE WHEN wrong > 1e-9 THEN 1 END) = 0 THEN 1 ELSE 0 END AS time_ok FROM ({steps}) c) d"""


CANDIDATES = ("p", "p_time", "p_mono")


@query("select_shippable", "model_id:s log_loss:d brier:d margin_ok:b time_ok:b", over("states", """
 SELECT * FROM (""" + " UNION ALL ".join(_gate_sql(v) for v in CANDIDATES) + ") c WHERE margin_ok = 1 AND time_ok = 1 ORDER BY log_loss, brier, model_id LIMIT 1", **SURFACE))
def select_shippable(t):
    surface = stored(_surface(t), "surface")
    states = t.states().filter("home_won is not null")
    parts = []
    for v in CANDIDATES:
        one = surface.select("margin", "j", F.col(v).alias("p_mono"))
        audit = X.monotone_audit(one, (LO, HI)).agg((F.sum("margin_drops") == 0).cast("int").alias("margin_ok"), (F.sum("time_drops") == 0).cast("int").alias("time_ok"))
        scored = X.surface_score(states, one, (LO, HI)).select(F.lit(v).alias("model_id"), F.col("home_won").alias("y"), "p")
        parts.append(M.attach_row(E.score(scored), audit))
    return M.select_shippable(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("bucket_gap", "family:s bucket:s n:b our_brier:d their_brier:d log_loss_gap:d", over("states", f"""
 SELECT family, bucket, COUNT(*) AS n, AVG((p - y) * (p - y)) AS our_brier, AVG((q - y) * (q - y)) AS their_brier, AVG({log_loss('p')}) - AVG({log_loss('q')}) AS log_loss_gap FROM
 (SELECT 'phase' AS family, CASE WHEN frac >= 0.75 THEN '1.00-0.75' WHEN frac >= 0.5 THEN '0.75-0.50' WHEN frac >= 0.25 THEN '0.50-0.25' ELSE '0.25-0.00' END AS bucket, p, q, y FROM b UNION ALL
  SELECT 'margin', CASE WHEN ABS(margin) = 0 THEN '0' WHEN ABS(margin) <= 3 THEN '1-3' WHEN ABS(margin) <= 7 THEN '4-7' WHEN ABS(margin) <= 12 THEN '8-12' ELSE '13+' END, p, q, y FROM b UNION ALL
  SELECT 'period', CAST(period AS VARCHAR), p, q, y FROM b) x GROUP BY 1, 2 HAVING COUNT(*) >= 100""",
    b=f"SELECT *, home_won AS y, {_wp('margin', 'frac')} AS p, CASE WHEN margin > 0 THEN 0.85e0 WHEN margin < 0 THEN 0.15e0 ELSE 0.5e0 END AS q FROM states WHERE home_won IS NOT NULL"))
def bucket_gap(t):
    f, m = F.col("frac"), F.abs("margin")
    s = t.states().filter("home_won is not null").withColumns({
        "y": F.col("home_won"), "p": normal_wp("margin", "frac", MU, SIGMA),
        "q": F.when(F.col("margin") > 0, 0.85).when(F.col("margin") < 0, 0.15).otherwise(0.5)})
    return E.bucket_gap(s, "p", "q", {
        "phase": F.when(f >= 0.75, "1.00-0.75").when(f >= 0.5, "0.75-0.50").when(f >= 0.25, "0.50-0.25").otherwise("0.25-0.00"),
        "margin": F.when(m == 0, "0").when(m <= 3, "1-3").when(m <= 7, "4-7").when(m <= 12, "8-12").otherwise("13+"),
        "period": F.col("period").cast("string")})


@query("state_band", "n:b home_wins:b actual:d predicted:d", over("states", f"""
 SELECT COUNT(*) AS n, SUM(home_won) AS home_wins, AVG(CAST(home_won AS DOUBLE)) AS actual, AVG({_wp('margin', 'frac')}) AS predicted FROM states WHERE home_won IS NOT NULL AND margin BETWEEN 2 AND 8 AND ABS(frac - 0.4e0) <= 0.1e0"""))
def state_band(t):
    s = t.states().filter("home_won is not null").withColumn("p", normal_wp("margin", "frac", MU, SIGMA))
    return E.state_band(s, (2, 8), 0.4, 0.1)


@query("augment_missing", "event_id:b copy:b margin:b value:d", over("states", "SELECT event_id, c AS copy, CASE WHEN c = 0 THEN margin END AS margin, CASE WHEN c = 0 THEN value END AS value FROM states CROSS JOIN range(3) r(c)"))
def augment_missing(t):
    return X.augment_missing(t.states().select("event_id", "margin", "value"), ["margin", "value"], 2)


@query("row_envelope", "event_id:b margin:b p_envelope:d", over("states", f"""
 SELECT s.event_id, s.margin, MAX(t.q) AS p_envelope FROM s JOIN (SELECT event_id, m, CASE WHEN m >= 0 THEN MAX(q) ELSE MIN(q) END AS q FROM
  (SELECT event_id, m, {_wp('m', 'f')} * 0.9e0 + 0.05e0 * sit AS q FROM (SELECT s.event_id, s.sit, s.margin - d.i AS m, CASE WHEN g.i < 0 THEN s.frac ELSE g.i / 10e0 END AS f FROM s CROSS JOIN range(5) d(i) JOIN range(-1, 11) g(i)
    ON g.i < 0 OR (s.margin - d.i <> 0 AND g.i / 10e0 >= s.frac - 1e-12)) x) y GROUP BY 1, 2) t ON t.event_id = s.event_id GROUP BY 1, 2""",
    s="SELECT event_id, margin, frac, CASE event_type WHEN 'click' THEN 1e0 WHEN 'view' THEN 0e0 ELSE 0.5e0 END AS sit FROM states"))
def row_envelope(t):
    kind = F.col("event_type")
    s = t.states().select("event_id", "margin", "frac", F.when(kind == "click", 1.0).when(kind == "view", 0.0).otherwise(0.5).alias("sit"))
    return X.row_envelope(s, ["sit"], [i / 10 for i in range(11)], 4, lambda m, f: normal_wp(m, f, MU, SIGMA) * 0.9 + 0.05 * F.col("sit"))
