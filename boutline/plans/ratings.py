"""Rating and strength queries."""

from pyspark.sql import Window, functions as F

from boutline.functions.features import add_deltas
from boutline.operators import history as H, ratings as R
from boutline.operators.joins import attach_sides
from boutline.plans.oracle import over
from boutline.plans.registry import query
from boutline.session import stored

RATED = "game_id:b league:s season:b home:b away:b home_elo:d away_elo:d prob:d home_post:d away_post:d"


def _decided(t):
    return t.games().filter("home_win is not null")


@query("elo_plain", RATED)
def elo_plain(t):
    return R.elo(_decided(t), R.PLAIN)[0]


@query("elo_season_carry", RATED)
def elo_season_carry(t):
    return R.elo(t.games().withColumn("neutral", F.col("game_id") % 50 == 0), R.CARRY)[0]


@query("elo_form_blend", RATED)
def elo_form_blend(t):
    return R.elo(_decided(t), R.FORM)[0]


@query("elo_log_margin", RATED)
def elo_log_margin(t):
    return R.elo(_decided(t), R.MARGIN)[0]


@query("elo_tuning", "league:s model_id:b n:b accuracy:d log_loss:d brier:d")
def elo_tuning(t):
    grid = [R.EloParams(k=k, home=h, carry=0.75, margin="capped", form_win=w, form_margin=m)
            for h in (35.0, 55.0, 75.0) for k in (14.0, 18.0, 22.0) for w in (80.0, 120.0, 160.0) for m in (20.0, 35.0, 50.0)]
    return R.tune_elo(_decided(t), grid)


@query("elo_latest", "league:s entity:b rating:d games:b")
def elo_latest(t):
    return R.latest_ratings(R.elo(_decided(t), R.CARRY)[0])


@query("opponent_strength", "game_id:b entity:b elo_pre:d opp_elo_last10:d")
def opponent_strength(t):
    rated = R.elo(_decided(t), R.PLAIN)[0]
    rows = rated.select("league", "season", "game_date", "game_id", F.inline(F.array(
        F.struct(F.col("home").alias("entity"), F.col("home_elo").alias("elo_pre"), F.col("away_elo").alias("opp_elo")),
        F.struct(F.col("away").alias("entity"), F.col("away_elo").alias("elo_pre"), F.col("home_elo").alias("opp_elo")))))
    rows = H.with_running(rows, ["entity"], H.DAY, H.TIE)
    return H.with_trailing(rows, ["entity"], {"opp_elo_last10": (10, H.mean_of("opp_elo", 3))})


SEASON_W = {"scored_pg": 1.15, "allowed_pg": -1.25, "win_pct": 0.9}
RECENT_W = {"l10_pct": 1.05, "l10_margin": 0.9, "trend": 0.7}
PROFILE = """SELECT entity, season, AVG(score) AS scored_pg, AVG(opp_score) AS allowed_pg, AVG(CAST(COALESCE(win, 0) AS DOUBLE)) AS win_pct, AVG(CASE WHEN late THEN CAST(COALESCE(win, 0) AS DOUBLE) END) AS l10_pct,
 CASE WHEN entity % 9 <> 0 THEN AVG(CASE WHEN late THEN diff END) END AS l10_margin, AVG(CASE WHEN late THEN CAST(COALESCE(win, 0) AS DOUBLE) END) - AVG(CAST(COALESCE(win, 0) AS DOUBLE)) AS trend,
 AVG(CAST(COALESCE(win, 0) AS DOUBLE)) AS prior, AVG(CASE WHEN is_home = 1 THEN CAST(COALESCE(win, 0) AS DOUBLE) END) AS home_pct, AVG(CASE WHEN is_home = 0 THEN CAST(COALESCE(win, 0) AS DOUBLE) END) AS road_pct,
 AVG(CASE WHEN is_home = 1 THEN diff END) AS home_margin, AVG(CASE WHEN is_home = 0 THEN diff END) AS road_margin
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, season ORDER BY game_date DESC, game_id DESC) <= 10 AS late FROM elog) x GROUP BY 1, 2"""


def _z(n, w):
    return f"{w}e0 * GREATEST(-3e0, LEAST(3e0, (COALESCE({n}, {n}_m) - {n}_m) / {n}_s))"


STRENGTH = dict(
    prof=PROFILE,
    st="SELECT season, " + ", ".join(f"QUANTILE_CONT({n}, 0.5) AS {n}_m, GREATEST((QUANTILE_CONT({n}, 0.75) - QUANTILE_CONT({n}, 0.25)) / 1.349e0, STDDEV_POP({n}) * 0.5e0, 1e-6) AS {n}_s" for n in [*SEASON_W, *RECENT_W]) + " FROM prof GROUP BY season",
    sc="SELECT *, 0.5e0 * season_score + 0.22e0 * coverage * recent_score + 0.33e0 * prior_logit AS strength FROM (SELECT prof.*, " + " + ".join(_z(n, w) for n, w in SEASON_W.items()) + " AS season_score, "
       + " + ".join(_z(n, w) for n, w in RECENT_W.items()) + " AS recent_score, (CASE WHEN l10_margin IS NULL THEN 2 ELSE 3 END) / 3e0 AS coverage, LN(GREATEST(0.05e0, LEAST(0.95e0, prior)) / (1e0 - GREATEST(0.05e0, LEAST(0.95e0, prior)))) AS prior_logit FROM prof JOIN st USING (season)) x")
# A season's pairs are judged by the profiles of the season before it.
PAIRS = "SELECT DISTINCT season, home, away FROM games"
SIDES = "h ON h.entity = pr.home AND h.season = pr.season - 1 JOIN {0} a ON a.entity = pr.away AND a.season = pr.season - 1"
BY = ["season"]


def _profiles(t):
    rows = H.with_running(t.log(), ["entity", "season"], H.DAY, H.TIE, totals={"n": H.run_count("game_id")})
    w, late, home = F.coalesce(F.col("win"), F.lit(0)).cast("double"), F.col("seq") > F.col("n") - 10, F.col("is_home") == 1
    p = rows.groupBy("entity", "season").agg(
        F.avg("score").alias("scored_pg"), F.avg("opp_score").alias("allowed_pg"), F.avg(w).alias("win_pct"),
        F.avg(F.when(late, w)).alias("l10_pct"), F.avg(F.when(late & (F.col("entity") % 9 != 0), F.col("diff"))).alias("l10_margin"),
        F.avg(F.when(home, w)).alias("home_pct"), F.avg(F.when(~home, w)).alias("road_pct"),
        F.avg(F.when(home, F.col("diff"))).alias("home_margin"), F.avg(F.when(~home, F.col("diff"))).alias("road_margin"))
    return p.withColumns({"trend": F.col("l10_pct") - F.col("win_pct"), "prior": F.col("win_pct")})


def _strength(t):
    return R.strength(_profiles(t), SEASON_W, RECENT_W, by=BY)


def _next(profiles):
    """Profiles under the season whose pairs they judge."""
    return profiles.withColumn("season", F.col("season") + 1)


def _pairs(t):
    return t.games().select("season", "home", "away").distinct()


def _known(rows):
    return rows.filter("home_strength is not null and away_strength is not null")


@query("strength", "entity:b season:b season_score:d recent_score:d coverage:d prior_logit:d strength:d", over("elog", "SELECT * FROM sc", **STRENGTH))
def strength(t):
    return _strength(t)


@query("pair_probability", "season:b home:b away:b base_diff:d location_edge:d p_home:d confidence:d", over("elog", """
 SELECT season, home, away, base_diff, location_edge, p AS p_home, ABS(p - 0.5e0) * 2e0 AS confidence FROM (SELECT *, 1e0 / (1e0 + EXP(-(base_diff + location_edge) * 0.6e0 / 1.8e0)) AS p FROM
 (SELECT pr.season, pr.home, pr.away, h.strength - a.strength AS base_diff, 0.18e0 + 0.65e0 * (h.home_pct - a.road_pct) + 0.35e0 * (h.home_margin - a.road_margin) AS location_edge
  FROM (""" + PAIRS + """) pr JOIN sc """ + SIDES.format("sc") + """) x) y""", **STRENGTH))
def pair_probability(t):
    return _known(R.pair_probability(_pairs(t), _next(_strength(t)), by=BY))


@query("what_if", "season:b home:b away:b base_p:d what_if_p:d", over("elog", """
 SELECT season, home, away, 1e0 / (1e0 + EXP(-(d) * 0.6e0 / 1.8e0)) AS base_p, 1e0 / (1e0 + EXP(-(d + CASE WHEN home % 5 = 0 THEN 0.4e0 ELSE 0e0 END - CASE WHEN away % 5 = 0 THEN 0.4e0 ELSE 0e0 END) * 0.6e0 / 1.8e0)) AS what_if_p FROM
 (SELECT pr.season, pr.home, pr.away, h.strength - a.strength AS d FROM (""" + PAIRS + """) pr JOIN sc """ + SIDES.format("sc") + """) x""", **STRENGTH))
def what_if(t):
    prof = stored(_next(_strength(t)), "strength")
    over_ = prof.filter("entity % 5 = 0").select("season", "entity", F.lit(0.4).alias("adjust"))
    base = _known(R.pair_probability(_pairs(t), prof, "neutral", BY)).select("season", "home", "away", F.col("p_home").alias("base_p"))
    alt = R.pair_probability(_pairs(t), R.with_overrides(prof, over_, "strength", BY), "neutral", BY).select("season", "home", "away", F.col("p_home").alias("what_if_p"))
    return base.join(alt, ["season", "home", "away"])


@query("top_pick_what_if", "season:b home:b away:b kind:s p_home:d", over("elog", """
 SELECT season, home, away, 'baseline' AS kind, p AS p_home FROM top WHERE r <= 10 UNION ALL SELECT season, home, away, 'what_if', 1e0 / (1e0 + EXP(-(d + 1e0) * 0.6e0 / 1.8e0)) FROM top WHERE r = 1""", **STRENGTH,
    top="SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY p DESC, home, away) AS r FROM (SELECT season, home, away, d, 1e0 / (1e0 + EXP(-(d) * 0.6e0 / 1.8e0)) AS p FROM (SELECT pr.season, pr.home, pr.away, h.strength - a.strength AS d FROM (" + PAIRS + ") pr JOIN sc " + SIDES.format("sc") + ") x) y"))
def top_pick_what_if(t):
    prof = stored(_next(_strength(t)), "strength")
    order = Window.partitionBy("season").orderBy(F.desc("p_home"), "home", "away")
    top = (_known(R.pair_probability(_pairs(t), prof, "neutral", BY)).select("season", "home", "away", "p_home", F.row_number().over(order).alias("r"))
           .filter("r <= 10"))  # the report is the ten best of a season
    top = stored(top, "top")
    first = top.filter("r = 1").select("season", "home", "away")
    bump = first.select("season", F.col("home").alias("entity"), F.lit(1.0).alias("adjust"))
    alt = R.pair_probability(first, R.with_overrides(prof, bump, "strength", BY), "neutral", BY)
    return (top.select("season", "home", "away", F.lit("baseline").alias("kind"), "p_home")
            .unionByName(alt.select("season", "home", "away", F.lit("what_if").alias("kind"), "p_home")))


@query("pair_features", "season:b home:b away:b home_win_pct:d away_win_pct:d diff_win_pct:d diff_l10_pct:d diff_scored_pg:d", over("elog", """
 SELECT pr.season, pr.home, pr.away, h.win_pct AS home_win_pct, a.win_pct AS away_win_pct, h.win_pct - a.win_pct AS diff_win_pct, h.l10_pct - a.l10_pct AS diff_l10_pct, h.scored_pg - a.scored_pg AS diff_scored_pg
 FROM (""" + PAIRS + """) pr JOIN prof """ + SIDES.format("prof"), prof=PROFILE))
def pair_features(t):
    rows = add_deltas(attach_sides(_pairs(t), _next(_profiles(t)), BY))
    return rows.filter("home_win_pct is not null and away_win_pct is not null")
