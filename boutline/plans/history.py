"""Pregame history queries."""

from pyspark.sql import functions as F

from boutline.operators import history as H
from boutline.plans.oracle import over
from boutline.plans.registry import query

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
FORM = f"""SELECT game_id, season, game_date, entity, is_home, win,
 COUNT(win) OVER c AS games, CAST(SUM(win) OVER c AS DOUBLE) / NULLIF(COUNT(win) OVER c, 0) AS season_pct,
 AVG(diff) OVER c AS season_gd, AVG(CAST(win AS DOUBLE)) OVER t10 AS last10_pct, AVG(diff) OVER t10 AS last10_gd,
 AVG(CAST(win AS DOUBLE)) OVER t5 AS last5_pct, AVG(diff) OVER t3 AS last3_gd,
 AVG(CASE WHEN is_home = 1 THEN CAST(win AS DOUBLE) END) OVER c AS home_pct,
 AVG(CASE WHEN is_home = 0 THEN CAST(win AS DOUBLE) END) OVER c AS away_pct
 FROM elog WHERE win IS NOT NULL
 WINDOW c AS (PARTITION BY entity, season ORDER BY game_date, game_id {BEFORE}),
 t10 AS (PARTITION BY entity, season ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
 t5 AS (PARTITION BY entity, season ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 t3 AS (PARTITION BY entity, season ORDER BY game_date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""
FEATURES = ["season_pct", "season_gd", "last10_pct", "last10_gd", "home_pct", "away_pct"]


@query("pregame_features",
       "game_id:b season:b game_date:t home:b away:b y:b " + " ".join(
           f"home_{f}:d away_{f}:d delta_{f}:d" for f in FEATURES),
       over("elog", """SELECT h.game_id, h.season, h.game_date, h.entity AS home, a.entity AS away, h.win AS y, """ + ", ".join(
           f"h.{f} AS home_{f}, a.{f} AS away_{f}, h.{f} - a.{f} AS delta_{f}" for f in FEATURES)
           + " FROM form h JOIN form a ON a.game_id = h.game_id AND h.is_home = 1 AND a.is_home = 0", form=FORM))
def pregame_features(t):
    rows = H.form_features(t.log()).withColumn("y", F.when(F.col("is_home") == 1, F.col("win")).otherwise(1 - F.col("win")))
    return H.pivot_sides(rows, ["game_id", "season", "game_date", "y"], FEATURES)


@query("form_log", "game_id:b entity:b season:b games:b season_pct:d season_gd:d last10_pct:d last10_gd:d last5_pct:d "
       "last3_gd:d home_pct:d away_pct:d", over("elog", "SELECT * FROM form", form=FORM))
def form_log(t):
    return H.form_features(t.log())


ORDERED = "PARTITION BY entity, season ORDER BY game_date, game_id"


@query("streaks_and_stands", "game_id:b entity:b streak:b home_stand:b road_trip:b", over("elog", """
 SELECT game_id, entity, CASE WHEN w > l THEN w - l ELSE -(l - w) END AS streak,
  CASE WHEN is_home = 1 THEN GREATEST(h - a, 0) + 1 ELSE 0 END AS home_stand,
  CASE WHEN is_home = 1 THEN 0 ELSE GREATEST(a - h, 0) + 1 END AS road_trip
 FROM (SELECT *, COALESCE(MAX(CASE WHEN win = 1 THEN rn END) OVER b, 0) AS w, COALESCE(MAX(CASE WHEN win = 0 THEN rn END) OVER b, 0) AS l,
   COALESCE(MAX(CASE WHEN is_home = 1 THEN rn END) OVER b, 0) AS h, COALESCE(MAX(CASE WHEN is_home = 0 THEN rn END) OVER b, 0) AS a
  FROM s WINDOW b AS (PARTITION BY entity, season ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""",
    s=f"SELECT *, ROW_NUMBER() OVER ({ORDERED}) AS rn FROM elog WHERE win IS NOT NULL"))
def streaks_and_stands(t):
    return H.runs(t.log().filter("win is not null"))


def _density_sql(part, rest, b2b):
    return over("elog", f"""SELECT game_id, entity, {rest} AS rest_days, {b2b} AS back_to_back,
 CASE WHEN g3 >= 2 THEN 1 ELSE 0 END AS three_in_four, CASE WHEN g5 >= 3 THEN 1 ELSE 0 END AS four_in_six
 FROM (SELECT *, date_diff('day', prev, game_date) AS gap FROM (SELECT *, LAG(game_date) OVER (PARTITION BY {part} ORDER BY game_date, game_id) AS prev,
  COUNT(*) OVER (PARTITION BY {part} ORDER BY game_date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS g3,
  COUNT(*) OVER (PARTITION BY {part} ORDER BY game_date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS g5
  FROM elog) x) y""")


DENSITY = "game_id:b entity:b rest_days:b back_to_back:b three_in_four:b four_in_six:b"


@query("rest_density", DENSITY, _density_sql("entity, season", "GREATEST(gap - 1, 0)",
       "CASE WHEN gap IS NOT NULL AND gap <= 1 THEN 1 ELSE 0 END").replace("GREATEST(gap - 1, 0)", "CASE WHEN gap IS NOT NULL THEN GREATEST(gap - 1, 0) END"))
def rest_density(t):
    return H.density(t.log(), ["entity", "season"])


@query("rest_density_capped", DENSITY, _density_sql("entity", "CASE WHEN gap IS NOT NULL THEN GREATEST(0, LEAST(10, gap)) END",
       "CASE WHEN gap IS NULL THEN NULL WHEN gap <= 1 THEN 1 ELSE 0 END"))
def rest_density_capped(t):
    return H.density(t.log(), ["entity"], max_rest=10)


NS = [3, 5, 10, 20]


@query("rolling_min_periods", "game_id:b entity:b " + " ".join(f"diff_last{n}:d score_last{n}:d" for n in NS), over("elog",
       "SELECT game_id, entity, " + ", ".join(
           f"CASE WHEN COUNT({c}) OVER w{n} >= 3 THEN AVG({c}) OVER w{n} END AS {c}_last{n}" for n in NS for c in ("diff", "score"))
       + " FROM elog WINDOW " + ", ".join(
           f"w{n} AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in NS)))
def rolling_min_periods(t):
    rows = H.with_running(t.log(), ["entity"], H.DAY, H.TIE)
    return H.with_trailing(rows, ["entity"], {
        f"{c}_last{n}": (n, H.mean_of(c, 3)) for n in NS for c in ("diff", "score")})


@query("rolling_strict_day", "game_id:b entity:b diff_last5:d score_last10:d season_diff:d", over("elog", """
 SELECT e.game_id, e.entity, d.d5 AS diff_last5, d.s10 AS score_last10, d.sd AS season_diff FROM elog e JOIN d ON d.entity = e.entity AND d.game_date = e.game_date""",
    f="""SELECT entity, game_date, AVG(diff) OVER w5 AS d5, AVG(score) OVER w10 AS s10,
 ROW_NUMBER() OVER (PARTITION BY entity, game_date ORDER BY game_id) AS k,
 AVG(diff) OVER (PARTITION BY entity, season ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS sd
 FROM elog WINDOW w5 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 w10 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    d="SELECT * FROM f WHERE k = 1"))
def rolling_strict_day(t):
    rows = H.with_running(t.log(), ["entity", "season"], H.DAY, H.TIE, strict_day=True,
                          running={"sum_diff": H.run_sum("diff"), "n_diff": H.run_count("diff")}).drop("seq")
    rows = H.with_running(rows, ["entity"], H.DAY, H.TIE)
    rows = H.with_trailing(rows, ["entity"], {"diff_last5": (5, H.mean_of("diff")), "score_last10": (10, H.mean_of("score"))})
    return (H.first_of_day(rows, ["entity"], H.DAY, H.TIE, ["diff_last5", "score_last10"])
            .withColumn("season_diff", F.try_divide("sum_diff", "n_diff")))


@query("career_to_date", "game_id:b entity:b games_before:b mean_score:d max_source_date:t", over("elog", """
 SELECT game_id, entity, COUNT(score) OVER w AS games_before, AVG(score) OVER w AS mean_score, MAX(game_date) OVER w AS max_source_date
 FROM elog WINDOW w AS (PARTITION BY entity ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"""))
def career_to_date(t):
    rows = H.with_running(t.log(), ["entity"], H.DAY, H.TIE, strict_day=True, running={
        "games_before": H.run_count("score"), "total": H.run_sum("score"), "max_source_date": H.run_max(H.DAY)})
    return rows.withColumn("mean_score", F.try_divide("total", "games_before"))


@query("travel_and_zone_shift", "game_id:b entity:b travel_miles:d zone_shift:d", over("elog dim", """
 SELECT game_id, entity, 2e0 * 3958.7613e0 * ASIN(SQRT(POWER(SIN((RADIANS(lat) - RADIANS(la)) / 2e0), 2) + COS(RADIANS(la)) * COS(RADIANS(lat))
  * POWER(SIN((RADIANS(lon) - RADIANS(lo)) / 2e0), 2))) AS travel_miles, off - lf AS zone_shift
 FROM (SELECT *, LAG(lat) OVER w AS la, LAG(lon) OVER w AS lo, LAG(off) OVER w AS lf FROM p
  WINDOW w AS (PARTITION BY entity, season ORDER BY game_date, game_id)) x""",
    p="""SELECT e.game_id, e.entity, e.season, e.game_date, d.lat, d.lon,
 epoch(noon - timezone('UTC', timezone(d.tz, noon))) / 3600e0 AS off
 FROM (SELECT *, CAST(game_date AS TIMESTAMP) + INTERVAL 12 HOUR AS noon FROM elog) e
 JOIN dim d ON d.entity = CASE WHEN is_home = 1 THEN e.entity ELSE e.opponent END"""))
def travel_and_zone_shift(t):
    return H.travel(t.log(), t.dim(), ["entity", "season"])


EWM = "CASE WHEN LEN(l) > 0 THEN LIST_REDUCE(l, LAMBDA a, x: {0}e0 * x + (1e0 - {0}e0) * a) END"


@query("ewm_volatility_accel", "game_id:b entity:b ewm45:d ewm35:d var5:d var10:d accel:d", over("elog", f"""
 SELECT game_id, entity, {EWM.format(0.45)} AS ewm45, {EWM.format(0.35)} AS ewm35, var5, var10, accel
 FROM (SELECT game_id, entity, LIST(diff) OVER w10 AS l, VAR_POP(diff) OVER w5 AS var5, VAR_POP(diff) OVER w10 AS var10,
  AVG(diff) OVER w3 - AVG(diff) OVER w10 AS accel FROM elog WINDOW
  w3 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) x"""))
def ewm_volatility_accel(t):
    rows = H.with_running(t.log(), ["entity"], H.DAY, H.TIE)
    rows = H.with_trailing(rows, ["entity"], {
        "ewm45": (10, H.ewm_of("diff", 0.45)), "ewm35": (10, H.ewm_of("diff", 0.35)),
        "var5": (5, lambda w: F.var_pop("diff").over(w)), "var10": (10, lambda w: F.var_pop("diff").over(w)),
        "m3": (3, H.mean_of("diff")), "m10": (10, H.mean_of("diff"))})
    return rows.withColumn("accel", F.col("m3") - F.col("m10"))


@query("h2h_prior", "game_id:b ordered_rate:d ordered_log_games:d focal_rate:d focal_log_games:d", over("games", """
 SELECT g.game_id, (COALESCE(p.ow, 0) + 8e0 * r.rate) / (COALESCE(p.og, 0) + 8e0) - 0.5e0 AS ordered_rate, LN(1e0 + COALESCE(p.og, 0)) AS ordered_log_games,
  (COALESCE(p.fw, 0) + 4e0) / (COALESCE(p.fg, 0) + 8e0) - 0.5e0 AS focal_rate, LN(1e0 + COALESCE(p.fg, 0)) AS focal_log_games
 FROM d g JOIN r ON r.season = g.season JOIN p ON p.me = g.home AND p.foe = g.away AND p.season = g.season""",
    d="SELECT * FROM games WHERE home_win IS NOT NULL",
    r="""SELECT season, COALESCE(CAST(SUM(w) OVER b AS DOUBLE) / SUM(n) OVER b, 0.5e0) AS rate FROM
 (SELECT season, SUM(home_win) AS w, COUNT(*) AS n FROM d GROUP BY 1) x WINDOW b AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    v="SELECT season, home AS me, away AS foe, home_win AS won, 1 AS hm FROM d UNION ALL SELECT season, away, home, 1 - home_win, 0 FROM d",
    p="""SELECT me, foe, season, SUM(fw) OVER b AS fw, SUM(fg) OVER b AS fg, SUM(ow) OVER b AS ow, SUM(og) OVER b AS og FROM
 (SELECT me, foe, season, SUM(won) AS fw, COUNT(*) AS fg, SUM(CASE WHEN hm = 1 THEN won ELSE 0 END) AS ow, SUM(hm) AS og FROM v GROUP BY 1, 2, 3) x
 WINDOW b AS (PARTITION BY me, foe ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def h2h_prior(t):
    return H.h2h_prior(t.games().filter("home_win is not null"))


@query("days_since_home_win", "game_id:b entity:b days_since:b starts_before:b", over("elog", f"""
 SELECT game_id, entity, date_diff('day', MAX(CASE WHEN is_home = 1 AND win = 1 THEN game_date END) OVER w, game_date) AS days_since,
  COUNT(CASE WHEN is_home = 1 AND win = 1 THEN 1 END) OVER w AS starts_before
 FROM elog WINDOW w AS (PARTITION BY entity ORDER BY game_date, game_id {BEFORE})"""))
def days_since_home_win(t):
    event = (F.col("is_home") == 1) & (F.col("win") == 1)
    rows = H.with_running(t.log(), ["entity"], H.DAY, H.TIE, running={
        "last_event": H.run_max(F.when(event, F.col(H.DAY))), "starts_before": H.run_count(F.when(event, 1))})
    return rows.withColumn("days_since", F.datediff(H.DAY, "last_event"))


@query("topk_mean", "game_id:b entity:b top2_points:d top3_points:d depth_share:d", over("members", """
 SELECT game_id, entity, AVG(CASE WHEN r <= 2 THEN points END) AS top2_points, AVG(CASE WHEN r <= 3 THEN points END) AS top3_points,
  (SUM(points) - SUM(CASE WHEN r <= 2 THEN points END)) / NULLIF(SUM(points), 0) AS depth_share
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, entity ORDER BY points DESC, member) AS r FROM members) x GROUP BY 1, 2"""))
def topk_mean(t):
    return H.topk_mean(t.members(), ["game_id", "entity"], "points", [2, 3], "member")


@query("set_continuity", "game_id:b entity:b active:b continuity:d turnover:b stability_last5:d continuity_ewm:d change_last5:d", over("members", f"""
 SELECT game_id, entity, active, continuity, turnover, AVG(continuity) OVER w5 AS stability_last5, AVG(1e0 - continuity) OVER w5 AS change_last5,
  {EWM.format(0.5).replace('l)', 'lst)').replace('(l,', '(lst,')} AS continuity_ewm
 FROM (SELECT *, LIST(continuity) FILTER (continuity IS NOT NULL) OVER (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lst FROM c) z
 WINDOW w5 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    r="SELECT entity, game_date, game_id, LIST(DISTINCT member) AS ros FROM members GROUP BY 1, 2, 3",
    q="SELECT *, LAG(ros) OVER (PARTITION BY entity ORDER BY game_date, game_id) AS pre FROM r",
    c="""SELECT entity, game_date, game_id, LEN(ros) AS active, CASE WHEN pre IS NOT NULL THEN CAST(LEN(LIST_INTERSECT(ros, pre)) AS DOUBLE) / LEN(ros) END AS continuity,
 CASE WHEN pre IS NOT NULL THEN LEN(ros) + LEN(pre) - 2 * LEN(LIST_INTERSECT(ros, pre)) ELSE 0 END AS turnover FROM q"""))
def set_continuity(t):
    return H.set_continuity(t.members(), t.parts("lineitem"))


@query("roster_churn", "game_id:b entity:b churn_7d:d churn_14d:d churn_30d:d", over("members", "SELECT * FROM x JOIN y USING (entity, game_date, game_id) JOIN z USING (entity, game_date, game_id)",
    m="SELECT DISTINCT entity, game_date, game_id, member FROM members", g="SELECT DISTINCT entity, game_date, game_id FROM members",
    **{k: f"""SELECT g.entity, g.game_date, g.game_id, COALESCE(CAST(COUNT(DISTINCT CASE WHEN h.member IS NULL THEN p.member END) AS DOUBLE) / NULLIF(COUNT(DISTINCT p.member), 0), 0) AS churn_{n}d
 FROM g LEFT JOIN m p ON p.entity = g.entity AND p.game_date < g.game_date AND p.game_date >= g.game_date - {n}
 LEFT JOIN m h ON h.entity = g.entity AND h.game_id = g.game_id AND h.member = p.member GROUP BY 1, 2, 3""" for k, n in (("x", 7), ("y", 14), ("z", 30))}))
def roster_churn(t):
    return H.roster_churn(t.members(), [7, 14, 30])


@query("recency_weights", "game_id:b weight:d raw:d", over("games", """
 SELECT game_id, raw, raw / AVG(raw) OVER () AS weight FROM (SELECT game_id, GREATEST(0.05e0, POWER(0.5e0, (DENSE_RANK() OVER (ORDER BY season DESC) - 1) / 2e0)
  * POWER(0.5e0, (COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY game_date, game_id)) / 5000e0)) AS raw FROM games) x"""))
def recency_weights(t):
    return H.recency_weights(t.games(), 2.0, 5000.0, 0.05)


@query("regime", "game_id:b seq:b regime:s", over("games", """
 SELECT game_id, rn AS seq, CASE WHEN rn / CAST(n AS DOUBLE) <= 1e0 / 3 THEN 'early' WHEN rn / CAST(n AS DOUBLE) <= 2e0 / 3 THEN 'mid' ELSE 'late' END AS regime
 FROM (SELECT game_id, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date, game_id) AS rn, COUNT(*) OVER (PARTITION BY season) AS n FROM games) x"""))
def regime(t):
    return H.regime(t.games())


@query("even_sample", "game_id:b seq:b", over("states", """
 SELECT s.game_id, s.seq FROM states s WHERE n <= 12 OR EXISTS (SELECT 1 FROM range(12) j(i) WHERE CAST(FLOOR(i * (n - 1) / 11e0) AS BIGINT) = s.seq - 1)"""))
def even_sample(t):
    return H.even_sample(t.states(), ["game_id"], 12)


@query("outcome_labels", "game_id:b seq:b margin:b final_margin:b remaining:b home_won:b frac:d period:b", over("states", """
 SELECT game_id, seq, margin, final_margin, final_margin - margin AS remaining, home_won, frac, period FROM states"""))
def outcome_labels(t):
    return t.states().withColumn("remaining", F.col("final_margin") - F.col("margin"))


@query("primary_member", "game_id:b entity:b member:b points:d changed:b prior_starts:b points_last8:d", over("members", """
 SELECT game_id, entity, member, points, CASE WHEN pm IS NULL THEN NULL WHEN pm <> member THEN 1 ELSE 0 END AS changed,
  ROW_NUMBER() OVER (PARTITION BY member ORDER BY game_date, game_id, entity) - 1 AS prior_starts,
  CASE WHEN COUNT(points) OVER w >= 3 THEN AVG(points) OVER w END AS points_last8
 FROM (SELECT *, LAG(member) OVER (PARTITION BY entity ORDER BY game_date, game_id) AS pm FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, entity ORDER BY points DESC, member) AS r FROM members) x WHERE r = 1) y
 WINDOW w AS (PARTITION BY member ORDER BY game_date, game_id, entity ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""))
def primary_member(t):
    return H.primary_member(t.members())


@query("member_prior", "game_id:b entity:b member:b games_before:b points_last3:d points_last5:d points_last10:d minutes_last5:d ewm:d source_through:t", over("members", f"""
 SELECT game_id, entity, member, games_before, points_last3, points_last5, points_last10, minutes_last5, {EWM.format(0.45)} AS ewm, source_through
 FROM (SELECT game_id, entity, member, COUNT(*) OVER c AS games_before, AVG(points) OVER w3 AS points_last3, AVG(points) OVER w5 AS points_last5,
  AVG(points) OVER w10 AS points_last10, AVG(minutes) OVER w5 AS minutes_last5, LIST(points) OVER w10 AS l, MAX(game_date) OVER c AS source_through
  FROM members WINDOW c AS (PARTITION BY member ORDER BY game_date, game_id, entity {BEFORE}),
  w3 AS (PARTITION BY member ORDER BY game_date, game_id, entity ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY member ORDER BY game_date, game_id, entity ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY member ORDER BY game_date, game_id, entity ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) x"""))
def member_prior(t):
    return H.member_prior(t.members())
