"""Season tables, joins, rankings, set operations and quality checks."""

from pyspark.sql import functions as F

from boutline.functions.cleaning import norm_key
from boutline.operators import aggregates as A, evaluate as E, history as H, joins as J, quality as V, timeline as TL
from boutline.plans.oracle import hit, log_loss, over
from boutline.plans.registry import query


@query("season_summary", "season:b entity:b games:b wins:b scored:d allowed:d win_pct:d diff_pg:d", over("elog", """
 SELECT season, entity, COUNT(*) AS games, COALESCE(SUM(win), 0) AS wins, SUM(score) AS scored, SUM(opp_score) AS allowed,
  CAST(COALESCE(SUM(win), 0) AS DOUBLE) / COUNT(*) AS win_pct, (SUM(score) - SUM(opp_score)) / COUNT(*) AS diff_pg FROM elog GROUP BY 1, 2"""))
def season_summary(t):
    return A.season_summary(t.log())


PLAYS = """SELECT l_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, YEAR(o_orderdate) AS season, {week} AS week, l_suppkey AS offense,
 l_partkey % 97 AS defense, l_returnflag <> 'N' AS is_pass, CAST(l_linenumber AS INT) AS down, l_quantity AS yards, CAST(l_partkey % 41 - 18 AS DOUBLE) / 8e0 AS epa, l_tax >= 0.07e0 AS turnover
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _plays(t):
    t.by_order(["l_suppkey", "l_partkey", "l_returnflag", "l_linenumber", "l_quantity", "l_tax"]).createOrReplaceTempView("boutline_lineitem")
    t.read("orders").createOrReplaceTempView("boutline_orders")
    return t.spark.sql(PLAYS.format(week="weekofyear(o_orderdate)").replace("FROM lineitem JOIN orders", "FROM boutline_lineitem JOIN boutline_orders"))


def _side(side, other):
    masks = {"": "TRUE", "pass_": "is_pass", "rush_": "NOT is_pass", "third_": "down = 3", "red_": "yards <= 20"}
    cols = ", ".join(f"SUM(CASE WHEN {m} THEN epa END) AS {p}epa, COUNT(CASE WHEN {m} THEN 1 END) AS {p}plays, AVG(CASE WHEN {m} THEN epa END) AS {p}epa_per_play, "
                     f"AVG(CASE WHEN {m} THEN CASE WHEN epa > 0 THEN 1e0 ELSE 0e0 END END) AS {p}success" for p, m in masks.items())
    return f"""SELECT season, week, {side} AS entity, COUNT(DISTINCT game_id) AS n_games, MAX(game_date) AS game_date, {cols}, SUM(CASE WHEN turnover THEN 1 ELSE 0 END) AS turnovers,
 AVG(CASE WHEN turnover THEN 1e0 ELSE 0e0 END) AS turnover_rate, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT {other})), ',') AS opponents FROM plays GROUP BY 1, 2, 3"""


SIDE_COLS = ["n_games:b", "game_date:t", "turnovers:b", "turnover_rate:d", "opponents:s"] + [
    f"{p}{c}" for p in ("", "pass_", "rush_", "third_", "red_") for c in ("epa:d", "plays:b", "epa_per_play:d", "success:d")]


@query("play_summary", "season:b week:b entity:b " + " ".join(SIDE_COLS) + " def_plays:b def_epa_per_play:d def_success:d def_turnover_rate:d def_third_success:d", over("", """
 SELECT o.* EXCLUDE (season, week, entity), COALESCE(o.season, d.season) AS season, COALESCE(o.week, d.week) AS week, COALESCE(o.entity, d.entity) AS entity,
  d.plays AS def_plays, d.epa_per_play AS def_epa_per_play, d.success AS def_success, d.turnover_rate AS def_turnover_rate, d.third_success AS def_third_success
 FROM off o FULL JOIN def d ON o.season = d.season AND o.week = d.week AND o.entity = d.entity""",
    plays=PLAYS.format(week="WEEKOFYEAR(o_orderdate)"), off=_side("offense", "defense"), **{"def": _side("defense", "offense")}))
def play_summary(t):
    p = _plays(t)
    k, parts = ["season", "week"], t.parts("lineitem")
    return A.both_sides(A.play_summary(p, "offense", k, parts), A.play_summary(p, "defense", k, parts), k)


@query("member_week_rate", "member:b season:b attempts:d total:d rate:d", over("members", """
 SELECT member, season, SUM(minutes + shots) AS attempts, SUM(points) AS total, SUM(points) / NULLIF(SUM(minutes + shots), 0) AS rate
 FROM members GROUP BY 1, 2 HAVING SUM(minutes + shots) >= 50"""))
def member_week_rate(t):
    return A.member_rate(t.members(), ["member", "season"], "points", ["minutes", "shots"], 50)


METRIC_NAMES = ["games", "wins", "scored", "allowed"]
LONG = " UNION ALL ".join(
    f"SELECT season, entity, '{m}' AS metric_name, CAST({m} AS DOUBLE) + {add} AS metric_value, '{s}' AS source, {snap} AS snapshot_id FROM ss WHERE {w}"
    for m in METRIC_NAMES for s, w, add, snap in (("summary", "entity % 3 <> 0", "0", "season % 4"), ("summary", "entity % 6 = 1", "0.5", "season % 4 + 1"), ("detail", "TRUE", "1000", "99")))


def _long(t):
    s = A.season_summary(t.log())
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("v")) for m in METRIC_NAMES]))
    rows = s.select("season", "entity", cells)
    e, y = F.col("entity"), F.col("season")
    copies = F.array_compact(F.array(
        F.when(e % 3 != 0, F.struct(F.lit("summary").alias("source"), F.lit(0.0).alias("add"), (y % 4).alias("snapshot_id"))),
        F.when(e % 6 == 1, F.struct(F.lit("summary").alias("source"), F.lit(0.5).alias("add"), (y % 4 + 1).alias("snapshot_id"))),
        F.struct(F.lit("detail").alias("source"), F.lit(1000.0).alias("add"), F.lit(99).alias("snapshot_id"))))
    return rows.select("*", F.inline(copies)).withColumn("metric_value", F.col("v") + F.col("add"))


SS = """SELECT season, entity, COUNT(*) AS games, COALESCE(SUM(win), 0) AS wins, SUM(score) AS scored, SUM(opp_score) AS allowed FROM elog GROUP BY 1, 2"""
WINNERS = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season, entity, metric_name ORDER BY CASE source WHEN 'summary' THEN 0 WHEN 'detail' THEN 1 ELSE 2 END, snapshot_id DESC) AS r FROM lng) x WHERE r = 1"""


@query("metric_winners", "season:b entity:b metric_name:s metric_value:d source:s", over("elog", "SELECT season, entity, metric_name, metric_value, source FROM win", ss=SS, lng=LONG, win=WINNERS))
def metric_winners(t):
    return A.source_priority(_long(t), ["season", "entity"], ["summary", "detail"])


@query("feature_base", "season:b entity:b name:s games:d wins:d scored:d allowed:d scored_pg:d members:b points:d top_points:d top_share:d points_per_game:d", over("elog members dim", """
 SELECT w.season, w.entity, d.name, w.games, w.wins, w.scored, w.allowed, COALESCE(w.scored / NULLIF(w.games, 0), 0) AS scored_pg, COALESCE(r.members, 0) AS members,
  COALESCE(r.points, 0) AS points, COALESCE(r.top_points, 0) AS top_points, COALESCE(r.top_points / NULLIF(r.points, 0), 0) AS top_share, COALESCE(r.points / r.g, 0) AS points_per_game
 FROM wide w JOIN dim d ON d.entity = w.entity LEFT JOIN ros r ON r.season = w.season AND r.entity = w.entity""",
    ss=SS, lng=LONG, win=WINNERS, wide="SELECT season, entity, " + ", ".join(f"MAX(CASE WHEN metric_name = '{m}' THEN metric_value END) AS {m}" for m in METRIC_NAMES) + " FROM win GROUP BY 1, 2",
    ros="""SELECT season, entity, COUNT(*) AS members, SUM(p) AS points, MAX(p) AS top_points, SUM(g) AS g FROM
 (SELECT season, entity, member, SUM(points) AS p, COUNT(*) AS g FROM members GROUP BY 1, 2, 3) x GROUP BY 1, 2"""))
def feature_base(t):
    k = ["season", "entity"]
    wide = A.pivot_metrics(A.source_priority(_long(t), k, ["summary", "detail"]), k, METRIC_NAMES)
    roster = A.roster_rollup(t.members(), k).drop("mean_points", "minutes", "member_games")
    out = wide.join(t.dim().select("entity", "name"), "entity").join(roster, k, "left")
    return out.fillna(0).withColumn("scored_pg", F.coalesce(F.try_divide("scored", "games"), F.lit(0.0)))


STAND_SQL = over("elog dim", """
 SELECT *, ROW_NUMBER() OVER (PARTITION BY season, conference, division ORDER BY win_pct DESC, w DESC, differential DESC, name) AS rank FROM
 (SELECT g.season, g.entity, d.name, d.conference, d.division, games, w, l, t, CAST(FLOOR((w + 0.5e0 * t) / games * 1000 + 0.5e0) / 1000e0 AS DOUBLE) AS win_pct, differential, last10, home_record, away_record,
   lst || CAST(games - GREATEST(CASE WHEN lst <> 'W' THEN COALESCE(pw, 0) ELSE 0 END, CASE WHEN lst <> 'L' THEN COALESCE(pl, 0) ELSE 0 END, CASE WHEN lst <> 'T' THEN COALESCE(pt, 0) ELSE 0 END) AS VARCHAR) AS streak
  FROM g JOIN dim d ON d.entity = g.entity) x""",
    r="""SELECT *, CASE WHEN win IS NULL THEN 'T' WHEN win = 1 THEN 'W' ELSE 'L' END AS res, ROW_NUMBER() OVER (PARTITION BY season, entity ORDER BY game_date, game_id) AS seq,
 COUNT(*) OVER (PARTITION BY season, entity) AS games FROM elog""",
    g="""SELECT season, entity, games, COUNT(CASE WHEN res = 'W' THEN 1 END) AS w, COUNT(CASE WHEN res = 'L' THEN 1 END) AS l, COUNT(CASE WHEN res = 'T' THEN 1 END) AS t, SUM(diff) AS differential,
 MAX(CASE WHEN seq = games THEN res END) AS lst, MAX(CASE WHEN res = 'W' THEN seq END) AS pw, MAX(CASE WHEN res = 'L' THEN seq END) AS pl, MAX(CASE WHEN res = 'T' THEN seq END) AS pt, """ + ", ".join(
        " || '-' || ".join(f"CAST(COUNT(CASE WHEN res = '{x}' AND {c} THEN 1 END) AS VARCHAR)" for x in "WLT") + f" AS {n}"
        for n, c in (("last10", "seq > games - 10"), ("home_record", "is_home = 1"), ("away_record", "is_home = 0"))) + " FROM r GROUP BY 1, 2, 3")


@query("standings", "season:b entity:b name:s conference:s division:s games:b w:b l:b t:b win_pct:d differential:d streak:s last10:s home_record:s away_record:s rank:b", STAND_SQL)
def standings(t):
    return A.standings(t.log(), t.dim()).withColumnsRenamed({"W": "w", "L": "l", "T": "t"})


@query("team_averages", "entity:b season:b score:d opp_score:d", over("elog", "SELECT entity, season, AVG(score) AS score, AVG(opp_score) AS opp_score FROM elog GROUP BY 1, 2"))
def team_averages(t):
    return t.log().groupBy("entity", "season").agg(F.avg("score").alias("score"), F.avg("opp_score").alias("opp_score"))


@query("member_totals", "member:b points:d minutes:d", over("members", "SELECT member, SUM(points) AS points, SUM(minutes) AS minutes FROM members GROUP BY 1 HAVING SUM(minutes) > 300"))
def member_totals(t):
    return A.totals_by(t.members(), ["member"], {"points": "points", "minutes": "minutes"}, F.col("minutes") > 300)


@query("season_quality", "season:b games:b ties:b binary_games:b home_rate:d ml_coverage:d home_favourite_share:d", over("odds", """
 SELECT season, COUNT(*) AS games, COUNT(*) - COUNT(home_win) AS ties, COUNT(home_win) AS binary_games, AVG(CAST(home_win AS DOUBLE)) AS home_rate, 1e0 AS ml_coverage,
  AVG(CASE WHEN spread_line > 0 THEN 1e0 ELSE 0e0 END) AS home_favourite_share FROM odds GROUP BY 1"""))
def season_quality(t):
    return A.season_quality(t.odds())


@query("team_count_check", "season:b observed:b expected:b ok:b", over("games", """
 SELECT season, n AS observed, CASE WHEN season < 2001 THEN 100 ELSE 90 END AS expected, CASE WHEN n = CASE WHEN season < 2001 THEN 100 ELSE 90 END THEN 1 ELSE 0 END AS ok
 FROM (SELECT season, COUNT(DISTINCT e) AS n FROM (SELECT season, home AS e FROM games UNION SELECT season, away FROM games) x GROUP BY 1) y"""))
def team_count_check(t):
    g = t.games()
    expected = g.select("season").distinct().withColumn("expected", F.when(F.col("season") < 2001, 100).otherwise(90))
    return A.team_count_check(g, expected)


@query("coverage", "first_date:t last_date:t n_rows:b sources:s", over("games", """
 SELECT MIN(game_date) AS first_date, MAX(game_date) AS last_date, COUNT(*) AS n_rows, (SELECT STRING_AGG(l, '|' ORDER BY l) FROM (SELECT DISTINCT league AS l FROM games) x) AS sources FROM games"""))
def coverage(t):
    return A.coverage(t.games(), "game_date", "game_id", "league")


@query("column_coverage", "name:s filled:b share:d", over("games", " UNION ALL ".join(
    f"SELECT '{c}' AS name, COUNT({c}) AS filled, CAST(COUNT({c}) AS DOUBLE) / COUNT(*) AS share FROM games"
    for c in ("game_id", "season", "game_date", "league", "home", "away", "home_score", "away_score", "margin", "home_win"))))
def column_coverage(t):
    return A.column_coverage(t.games())


@query("column_stats", "name:s low:d high:d median:d null_rate:d", over("games", " UNION ALL ".join(
    f"SELECT '{c}' AS name, MIN({c}) AS low, MAX({c}) AS high, QUANTILE_CONT({c}, 0.5) AS median, AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_rate FROM games"
    for c in ("margin", "home_score", "home_win"))))
def column_stats(t):
    return A.column_stats(t.games(), ["margin", "home_score", "home_win"])


@query("correlations", "a:s b:s r:d", over("pw", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS r FROM pw" for a in ("p_form", "p_market", "p_prior") for b in ("margin", "home_win", "p_form") if a != b)))
def correlations(t):
    return A.corr_matrix(t.preds_wide(), ["p_form", "p_market", "p_prior"], ["margin", "home_win", "p_form"])


@query("entity_profile", "entity:b games:b win_rate:d margin:d", over("elog", """
 SELECT entity, COUNT(*) AS games, AVG(CAST(win AS DOUBLE)) AS win_rate, AVG(diff) AS margin FROM elog WHERE game_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1"""))
def entity_profile(t):
    return A.entity_profile(t.log(), "1996-01-01", "1998-12-31")


@query("latest_profile", "entity:b win:b score:d opponent:b", over("elog", """
 SELECT entity, MAX(CASE WHEN rw = 1 AND win IS NOT NULL THEN win END) AS win, MAX(CASE WHEN r = 1 THEN score END) AS score, MAX(CASE WHEN r = 1 THEN opponent END) AS opponent
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY game_date DESC, game_id DESC) AS r,
  ROW_NUMBER() OVER (PARTITION BY entity, win IS NULL ORDER BY game_date DESC, game_id DESC) AS rw FROM elog) x GROUP BY 1"""))
def latest_profile(t):
    return A.latest_profile(t.log(), ["win", "score", "opponent"], ["game_date", "game_id"])


@query("dedupe_entities", "key:s canonical:s n_rows:b n_sources:b sources:s", """
 SELECT LOWER(REGEXP_REPLACE(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, MIN(p_name) AS canonical, COUNT(*) AS n_rows, COUNT(DISTINCT p_brand) AS n_sources,
  ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT p_brand)), '|') AS sources FROM part GROUP BY 1""")
def dedupe_entities(t):
    return A.dedupe_entities(t.read("part"), norm_key("p_name"), "p_brand", "p_name")


@query("gap_to_success", "club:b games:b goals:b mean_needed:d within_5:d within_10:d within_15:d", over("states", """
 SELECT club, COUNT(DISTINCT game_id) AS games, COUNT(*) AS goals, AVG(CAST(needed AS DOUBLE)) AS mean_needed, """ + ", ".join(
    f"AVG(CASE WHEN needed <= {k} THEN 1e0 ELSE 0e0 END) AS within_{k}" for k in (5, 10, 15)) + """
 FROM (SELECT game_id % 10 AS club, game_id, s - LAG(s, 1, 0) OVER (PARTITION BY game_id ORDER BY ts, event_id) + 1 AS needed
  FROM (SELECT *, COUNT(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY game_id ORDER BY ts, event_id) AS s FROM ev) x WHERE event_type = 'purchase') y GROUP BY 1"""))
def gap_to_success(t):
    ev = t.read("events").select(F.col("user_id").alias("game_id"), "ts", "event_id", "event_type", F.to_date("ts").alias("day"))
    kind = F.col("event_type")
    gaps = A.gap_to_success(ev, "game_id", "day", ["ts", "event_id"], kind == "click", kind == "purchase")
    return A.gap_shares(gaps.withColumn("club", F.col("game_id") % 10), "club")


@query("first_by", "home:b game_id:b away:b", over("games", "SELECT home, game_id, away FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY home ORDER BY game_date, game_id) AS r FROM games) x WHERE r = 1"))
def first_by(t):
    return A.first_by(t.games(), ["home"], ["game_date", "game_id"], ["game_id", "away"])


@query("distinct_seasons", "season:b", over("games", "SELECT DISTINCT season FROM games"))
def distinct_seasons(t):
    return t.games().select("season").distinct()


@query("leaders_high", "member:b points:d", over("members", "SELECT member, SUM(points) AS points FROM members GROUP BY 1 ORDER BY points DESC, member LIMIT 25"))
def leaders_high(t):
    return A.leaders(t.members().groupBy("member").agg(F.sum("points").alias("points")), "points", 25, tie="member")


@query("leaders_low", "entity:b allowed:d", over("elog", "SELECT entity, AVG(opp_score) AS allowed FROM elog GROUP BY 1 ORDER BY allowed, entity LIMIT 10"))
def leaders_low(t):
    return A.leaders(t.log().groupBy("entity").agg(F.avg("opp_score").alias("allowed")), "allowed", 10, lower_is_better=True)


@query("best_candidate", "season:b model_id:s log_loss:d", over("preds", f"""
 SELECT season, model_id, log_loss FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY log_loss, brier, -accuracy, model_id) AS r FROM
 (SELECT season, model_id, AVG({log_loss()}) AS log_loss, AVG((p - y) * (p - y)) AS brier, AVG({hit()}) AS accuracy FROM preds GROUP BY 1, 2) x) y WHERE r = 1"""))
def best_candidate(t):
    return A.best_candidate(E.score(t.preds(), ["season", "model_id"]), ["season"])


@query("dates_and_openers", "season:b opener:t next_after:t completed_games:b", over("games", """
 SELECT s.season, s.opener, (SELECT MIN(game_date) FROM games WHERE game_date > DATE '1998-03-15') AS next_after, l.games AS completed_games
 FROM (SELECT season, MIN(game_date) AS opener FROM games GROUP BY 1) s LEFT JOIN (SELECT season, COUNT(*) AS games FROM games GROUP BY 1 HAVING MAX(game_date) <= DATE '2000-12-31' ORDER BY 1 DESC LIMIT 3) l USING (season)"""))
def dates_and_openers(t):
    g = t.games()
    openers = g.groupBy("season").agg(F.min("game_date").alias("opener"))
    nxt = A.next_date(g, "1998-03-15").withColumnRenamed("next_date", "next_after")
    last = A.last_seasons(g, "2000-12-31", 3).select("season", F.col("games").alias("completed_games"))
    return J.attach_row(openers, nxt).join(last, "season", "left")


@query("upcoming", "game_id:b game_date:t", over("games", "SELECT game_id, game_date FROM games WHERE game_date >= DATE '2001-06-01' AND home_win IS NULL ORDER BY game_date NULLS LAST, game_id LIMIT 20"))
def upcoming(t):
    return (t.games().filter((F.col("game_date") >= F.to_date(F.lit("2001-06-01"))) & F.col("home_win").isNull())
            .orderBy(F.asc_nulls_last("game_date"), "game_id").limit(20))


@query("set_operations", "op:s entity:b n:b", over("games", """
 SELECT 'union' AS op, e AS entity, COUNT(*) AS n FROM (SELECT season, home AS e FROM games UNION SELECT season, away FROM games) x GROUP BY 2
 UNION ALL SELECT 'except', s_suppkey, 1 FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT home FROM games WHERE season = 1996 AND margin > 20) y
 UNION ALL SELECT 'intersect', home, 1 FROM (SELECT home FROM games WHERE season = 1995 INTERSECT SELECT away FROM games WHERE season = 1996) z"""))
def set_operations(t):
    g = t.games()
    u = (g.select("season", F.col("home").alias("entity")).union(g.select("season", "away")).distinct()
         .groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select(F.lit("union").alias("op"), "entity", "n"))
    e = t.read("supplier").select(F.col("s_suppkey").alias("entity")).subtract(g.filter("season = 1996 and margin > 20").select("home"))
    i = g.filter("season = 1995").select(F.col("home").alias("entity")).intersect(g.filter("season = 1996").select("away"))
    return (u.unionByName(e.select(F.lit("except").alias("op"), "entity", F.lit(1).cast("long").alias("n")))
            .unionByName(i.select(F.lit("intersect").alias("op"), "entity", F.lit(1).cast("long").alias("n"))))


STATUS_ROWS = """SELECT o_orderkey % 4000 AS game_id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'live' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'postponed' ELSE 'scheduled' END END AS status,
 o_orderdate AS start, o_orderkey AS ord FROM orders"""


def _status_rows(t):
    t.read("orders").createOrReplaceTempView("boutline_orders")
    return t.spark.sql(STATUS_ROWS.replace("FROM orders", "FROM boutline_orders"))


@query("dedupe_status", "game_id:b status:s ord:b", over("", """
 SELECT game_id, status, ord FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY CASE status WHEN 'final' THEN 3 WHEN 'live' THEN 2 WHEN 'postponed' THEN 1 ELSE 0 END DESC, ord DESC) AS r FROM s) x WHERE r = 1""", s=STATUS_ROWS))
def dedupe_status(t):
    return A.most_progressed(_status_rows(t), "game_id", "status", ["ord"])


@query("dedupe_rescheduled", "game_id:b status:s start:ts", over("", """
 SELECT game_id, status, start FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY CASE WHEN status = 'postponed' THEN 0 ELSE 1 END DESC, start DESC, ord DESC) AS r FROM s) x WHERE r = 1""", s=STATUS_ROWS))
def dedupe_rescheduled(t):
    rows = _status_rows(t).withColumn("at", F.struct("start", "ord"))
    return A.collapse_rescheduled(rows, "game_id", "status", "at")


@query("live_window", "game_id:b status:s", over("", """
 SELECT game_id, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY CASE WHEN status = 'postponed' THEN 0 ELSE 1 END DESC, start DESC, ord DESC) AS r FROM s
  WHERE CAST(start AS DATE) BETWEEN DATE '1998-05-30' AND DATE '1998-06-01') x WHERE r = 1 AND status = 'live'""", s=STATUS_ROWS))
def live_window(t):
    near = _status_rows(t).filter(F.to_date("start").between(F.to_date(F.lit("1998-05-30")), F.to_date(F.lit("1998-06-01"))))
    return A.collapse_rescheduled(near.withColumn("at", F.struct("start", "ord")), "game_id", "status", "at").filter("status = 'live'")


@query("later_source_wins", "game_id:b origin:s", over("games", """
 SELECT game_id, 'second' AS origin FROM games WHERE season >= 1998 UNION ALL SELECT game_id, 'first' FROM games WHERE season <= 1999 AND game_id NOT IN (SELECT game_id FROM games WHERE season >= 1998)"""))
def later_source_wins(t):
    g = t.games().select("game_id", "season")
    return A.later_source_wins(g.filter("season <= 1999").withColumn("origin", F.lit("first")),
                               g.filter("season >= 1998").withColumn("origin", F.lit("second")), ["game_id"])


@query("prev_season_lookup", "entity:b season:b prev_win_pct:d prior_win_pct:d", over("elog", """
 SELECT a.entity, a.season, b.p AS prev_win_pct, c.p AS prior_win_pct FROM x a LEFT JOIN (SELECT season, LAG(season) OVER (ORDER BY season) AS prev FROM (SELECT DISTINCT season FROM x) s) l ON l.season = a.season
 LEFT JOIN x b ON b.entity = a.entity AND b.season = l.prev LEFT JOIN x c ON c.entity = a.entity AND c.season = a.season - 1""",
    x="SELECT entity, season, CAST(COALESCE(SUM(win), 0) AS DOUBLE) / COUNT(*) AS p FROM elog WHERE season <> 1997 OR entity % 2 = 0 GROUP BY 1, 2"))
def prev_season_lookup(t):
    s = A.season_summary(t.log().filter("season <> 1997 or entity % 2 = 0")).select("entity", "season", "win_pct")
    a = J.previous_present(s, "entity", "season", ["win_pct"])
    b = J.previous_present(s, "entity", "season", ["win_pct"], step="calendar")
    return a.join(b.select("entity", "season", F.col("prev_win_pct").alias("prior_win_pct")), ["entity", "season"])


@query("asof_latest", "game_id:b entity:b last_home_game:b last_home_score:d", over("elog", """
 SELECT e.game_id, e.entity, h.game_id AS last_home_game, h.score AS last_home_score FROM elog e LEFT JOIN
 (SELECT e.game_id AS g, e.entity AS n, MAX(STRUCT_PACK(d := h.game_date, i := h.game_id)) AS k FROM elog e JOIN elog h ON h.entity = e.entity AND h.is_home = 1 AND h.game_date < e.game_date GROUP BY 1, 2) m
  ON m.g = e.game_id AND m.n = e.entity LEFT JOIN elog h ON h.entity = e.entity AND h.game_id = m.k.i"""))
def asof_latest(t):
    log = t.log()
    past = log.filter("is_home = 1").select("entity", "game_date", F.col("game_id").alias("last_home_game"), F.col("score").alias("last_home_score"))
    return TL.latest_before(log.select("game_id", "entity", "game_date"), past, ["entity"], "game_date", ["last_home_game"], ["last_home_game", "last_home_score"])


@query("roster_stats_join", "game_id:b entity:b member:b points:d shots:d", over("members", """
 SELECT r.game_id, r.entity, r.member, COALESCE(s.points, 0) AS points, COALESCE(s.shots, 0) AS shots FROM members r LEFT JOIN (SELECT * FROM members WHERE shots > 3) s
 ON s.game_id = r.game_id AND s.entity = r.entity AND s.member = r.member"""))
def roster_stats_join(t):
    m = t.members()
    return m.select("game_id", "entity", "member").join(
        m.filter("shots > 3").select("game_id", "entity", "member", "points", "shots"), ["game_id", "entity", "member"], "left").fillna(0.0)


@query("side_rosters", "game_id:b home_points:d away_points:d home_top:d away_top:d delta_points:d", over("games members", """
 SELECT g.game_id, COALESCE(h.p, 0) AS home_points, COALESCE(a.p, 0) AS away_points, COALESCE(h.m, -1) AS home_top, COALESCE(a.m, -1) AS away_top, COALESCE(h.p, 0) - COALESCE(a.p, 0) AS delta_points
 FROM games g LEFT JOIN r h ON h.game_id = g.game_id AND h.entity = g.home LEFT JOIN r a ON a.game_id = g.game_id AND a.entity = g.away""",
    r="SELECT game_id, entity, SUM(points) AS p, MAX(points) AS m FROM members WHERE minutes > 20 GROUP BY 1, 2"))
def side_rosters(t):
    r = t.members().filter("minutes > 20").groupBy("game_id", "entity").agg(F.sum("points").alias("points"), F.max("points").alias("top"))
    out = J.attach_sides(t.games().select("game_id", "home", "away"), r, ["game_id"])
    out = out.fillna(0.0, ["home_points", "away_points"]).fillna(-1.0, ["home_top", "away_top"])
    return out.withColumn("delta_points", F.col("home_points") - F.col("away_points"))


@query("signal_fill", "game_id:b signal:d", over("games", """
 SELECT g.game_id, COALESCE(o.o_totalprice / 1000e0, 0.5e0) AS signal FROM games g LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = g.game_id"""))
def signal_fill(t):
    s = t.read("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("game_id"), (F.col("o_totalprice") / 1000.0).alias("signal"))
    return J.fill_signal(t.games().select("game_id"), s, ["game_id"], {"signal": 0.5})


@query("validated_join", "game_id:b margin:d o_totalprice:d", over("games", "SELECT game_id, margin, o_totalprice FROM games LEFT JOIN orders ON o_orderkey = game_id"))
def validated_join(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("game_id"), "o_totalprice")
    return J.one_to_one(t.games().select("game_id", "margin"), o, ["game_id"])


@query("reconcile", "entity:b season:b d_wins:b p_wins:b in_d:b in_p:b", over("elog", """
 SELECT COALESCE(d.entity, p.entity) AS entity, COALESCE(d.season, p.season) AS season, d.wins AS d_wins, p.wins AS p_wins, d.one AS in_d, p.one AS in_p FROM a d FULL JOIN b p ON p.entity = d.entity AND p.season = d.season
 WHERE d.wins IS DISTINCT FROM p.wins OR d.one IS NULL OR p.one IS NULL""",
    a="SELECT entity, season, SUM(win) AS wins, 1 AS one FROM elog GROUP BY 1, 2", b="SELECT entity, season, SUM(win) + CASE WHEN entity % 7 = 0 THEN 1 ELSE 0 END AS wins, 1 AS one FROM elog WHERE entity % 13 <> 0 GROUP BY 1, 2"))
def reconcile(t):
    d = t.log().groupBy("entity", "season").agg(F.sum("win").alias("wins"))
    p = d.filter("entity % 13 <> 0").withColumn("wins", F.col("wins") + F.when(F.col("entity") % 7 == 0, 1).otherwise(0))
    return J.reconcile(d, p, ["entity", "season"], ["wins"])


@query("anti_and_semi", "kind:s s_suppkey:b", over("games", """
 SELECT 'anti' AS kind, s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT home FROM games WHERE season = 1995 AND margin > 30)
 UNION ALL SELECT 'semi', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT home FROM games WHERE season = 1995 AND margin > 30)"""))
def anti_and_semi(t):
    s = t.read("supplier").select("s_suppkey")
    k = t.games().filter("season = 1995 and margin > 30").select(F.col("home").alias("s_suppkey"))
    return (s.join(k, "s_suppkey", "left_anti").select(F.lit("anti").alias("kind"), "s_suppkey")
            .union(s.join(k, "s_suppkey", "left_semi").select(F.lit("semi"), "s_suppkey")))


@query("schedule_window", "game_id:b game_date:t", over("games", "SELECT game_id, game_date FROM games WHERE game_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-14'"))
def schedule_window(t):
    return t.games().filter(F.col("game_date").between(F.to_date(F.lit("1997-03-01")), F.to_date(F.lit("1997-03-14"))))


@query("prediction_lookup", "game_id:b p:d label:s pick_home:b y:b", over("pw", """
 SELECT game_id, p, CASE WHEN ABS(p - 0.5e0) >= 0.2e0 THEN 'high' WHEN ABS(p - 0.5e0) >= 0.1e0 THEN 'medium' ELSE 'low' END AS label, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS pick_home, home_win AS y
 FROM (SELECT *, GREATEST(0.15e0, LEAST(0.85e0, p_market)) AS p FROM pw WHERE season = 1999 AND WEEKOFYEAR(game_date) BETWEEN 10 AND 20) x"""))
def prediction_lookup(t):
    from boutline.functions.odds import clamp

    p = clamp("p_market", 0.15, 0.85)
    rows = t.preds_wide().filter((F.col("season") == 1999) & F.weekofyear("game_date").between(10, 20))
    return rows.select("game_id", p.alias("p"), J.confidence_label(p, [("high", 0.2), ("medium", 0.1)], "low").alias("label"),
                       (p >= 0.5).cast("int").alias("pick_home"), F.col("home_win").alias("y"))


@query("team_documents", "entity:b name:s season:b wins:b rank:b mean_score:d", over("elog dim", f"""
 SELECT d.entity, d.name, s.season, s.w AS wins, s.rank, a.score AS mean_score FROM dim d LEFT JOIN ({STAND_SQL}) s ON s.entity = d.entity
 LEFT JOIN (SELECT entity, season, AVG(score) AS score FROM elog GROUP BY 1, 2) a ON a.entity = s.entity AND a.season = s.season"""))
def team_documents(t):
    log = t.log()
    st = A.standings(log, t.dim()).select("entity", "season", F.struct(F.col("W").alias("wins"), "rank").alias("standing"))
    avg = log.groupBy("entity", "season").agg(F.struct(F.avg("score").alias("score")).alias("averages"))
    doc = t.dim().select("entity", "name").join(st, "entity", "left").join(avg, ["entity", "season"], "left")
    return doc.select("entity", "name", "season", "standing.wins", "standing.rank", F.col("averages.score").alias("mean_score"))


@query("duplicate_keys", "l_orderkey:b l_linenumber:b copies:b", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_keys(t):
    return V.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("unique_key", "n_rows:b n_keys:b max_copies:b", "SELECT SUM(k) AS n_rows, COUNT(*) AS n_keys, MAX(k) AS max_copies FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY l_orderkey, l_partkey) x")
def unique_key(t):
    return V.unique_key(t.read("lineitem"), ["l_orderkey", "l_partkey"])


@query("balanced_totals", "season:b wins:b losses:b home_rows:b away_rows:b balanced:b", over("elog", """
 SELECT season, SUM(win) AS wins, SUM(1 - win) AS losses, SUM(is_home) AS home_rows, SUM(1 - is_home) AS away_rows, CASE WHEN SUM(win) = SUM(1 - win) AND SUM(is_home) = SUM(1 - is_home) THEN 1 ELSE 0 END AS balanced FROM elog GROUP BY 1"""))
def balanced_totals(t):
    return V.balanced_totals(t.log())


@query("rule_counts", "rule:s checked:b broken:b", over("states games", """
 SELECT 'frac_in_unit' AS rule, COUNT(*) AS checked, COUNT(CASE WHEN NOT (frac >= 0 AND frac <= 1) THEN 1 END) AS broken FROM states UNION ALL SELECT 'value_below_40', COUNT(*), COUNT(CASE WHEN NOT value < 40 THEN 1 END) FROM states
 UNION ALL SELECT 'no_self_game', COUNT(*), COUNT(CASE WHEN home = away THEN 1 END) FROM games"""))
def rule_counts(t):
    a = V.rule_counts(t.states(), {"frac_in_unit": F.col("frac").between(0, 1), "value_below_40": F.col("value") < 40})
    return a.union(V.rule_counts(t.games(), {"no_self_game": F.col("home") != F.col("away")}))


@query("dead_letters", "reason:s n:b", """
 SELECT COALESCE(reason, 'good') AS reason, COUNT(*) AS n FROM (SELECT CASE WHEN NOT l_discount < 0.08 THEN 'discount' WHEN NOT l_quantity > 5 THEN 'quantity' END AS reason FROM lineitem) x GROUP BY 1""")
def dead_letters(t):
    good, bad = V.split_valid(t.read("lineitem"), {"discount": F.col("l_discount") < 0.08, "quantity": F.col("l_quantity") > 5})
    n = F.count(F.lit(1)).alias("n")
    return bad.groupBy("reason").agg(n).union(good.groupBy(F.lit("good").alias("reason")).agg(n))


@query("constant_columns", "name:s constant:b", over("odds", "SELECT 'fixed' AS name, 1 AS constant UNION ALL SELECT 'season', CASE WHEN MIN(season) = MAX(season) THEN 1 ELSE 0 END FROM odds UNION ALL SELECT 'margin', CASE WHEN MIN(margin) = MAX(margin) THEN 1 ELSE 0 END FROM odds"))
def constant_columns(t):
    return V.constant_columns(t.odds().withColumn("fixed", F.lit(1)), ["fixed", "season", "margin"])


@query("spot_check", "entity:b season:b ok:b", over("elog", """
 SELECT e.entity, e.season, CASE WHEN e.wins = x.w THEN 1 ELSE 0 END AS ok FROM (SELECT s_suppkey AS entity, 1996 AS season, 25 AS wins FROM supplier) e
 LEFT JOIN (SELECT entity, season, SUM(win) AS w FROM elog GROUP BY 1, 2) x USING (entity, season)"""))
def spot_check(t):
    got = t.log().groupBy("entity", "season").agg(F.sum("win").alias("wins"))
    exp = t.read("supplier").select(F.col("s_suppkey").alias("entity"), F.lit(1996).alias("season"), F.lit(25).cast("long").alias("wins"))
    return V.spot_check(got, ["entity", "season"], exp, ["wins"])


@query("exclude_synthetic", "game_id:b season:b margin:d", over("odds", "SELECT game_id, season, margin FROM odds WHERE season NOT IN (1995, 1996)"))
def exclude_synthetic(t):
    return V.exclude_synthetic(t.odds(), F.col("season").isin(1995, 1996), ["home_ml", "away_ml", "spread_line"])


@query("fill_median", "game_id:b home_win:d capped:d", over("games", """
 SELECT game_id, COALESCE(CAST(home_win AS DOUBLE), (SELECT QUANTILE_CONT(home_win, 0.5) FROM games)) AS home_win, COALESCE(CASE WHEN margin < 40 THEN margin END, (SELECT QUANTILE_CONT(margin, 0.5) FROM games WHERE margin < 40)) AS capped FROM games"""))
def fill_median(t):
    return V.fill_median(t.games().withColumn("capped", F.when(F.col("margin") < 40, F.col("margin"))), ["home_win", "capped"])


@query("season_scope", "season:b n0:b n1:b", over("games members", """
 SELECT a.season, a.n AS n0, b.n AS n1 FROM (SELECT season, COUNT(DISTINCT home) AS n FROM games GROUP BY 1 HAVING COUNT(DISTINCT home) >= 10) a
 JOIN (SELECT season, COUNT(DISTINCT member) AS n FROM members GROUP BY 1 HAVING COUNT(DISTINCT member) >= 10) b ON a.season = b.season ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 1"""))
def season_scope(t):
    return V.season_scope([(t.games(), "home", 10), (t.members(), "member", 10)])


@query("monotone_violations", "game_id:b seq:b value:d prev_value:d", over("states", """
 SELECT game_id, seq, value, prev AS prev_value FROM (SELECT game_id, seq, value, LAG(value) OVER (PARTITION BY game_id ORDER BY seq) AS prev FROM states) x WHERE value > prev + 1e-9"""))
def monotone_violations(t):
    rows = TL.with_trailing(t.states(), ["game_id"], {"prev_value": (1, lambda w: F.first("value").over(w))})
    return rows.filter(F.col("value") > F.col("prev_value") + 1e-9)


@query("upsert", "game_id:b margin:d version:b", over("games", """
 SELECT game_id, CASE WHEN season >= 1999 THEN margin + 1 ELSE margin END AS margin, CASE WHEN season >= 1999 THEN 2 ELSE 1 END AS version FROM games"""))
def upsert(t):
    g = t.games().select("game_id", "margin", "season")
    return A.upsert(g.withColumn("version", F.lit(1)),
                    g.filter("season >= 1999").withColumns({"margin": F.col("margin") + 1, "version": F.lit(2)}), ["game_id"], "version")


@query("pending_work", "game_id:b season:b pick:b", over("games", """
 SELECT game_id, season, pick FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date, game_id) AS pick FROM games WHERE game_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) x WHERE pick <= 40 ORDER BY season, pick LIMIT 90"""))
def pending_work(t):
    done = t.read("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("game_id"))
    return A.pending(t.games(), done, "game_id", 40, most=90)


@query("quota_sample", "game_id:b season:b pick:b", over("games", """
 SELECT game_id, season, pick FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY game_date, game_id) AS pick FROM games) x WHERE pick <= CASE season WHEN 1996 THEN 34 WHEN 1997 THEN 33 WHEN 1998 THEN 33 ELSE 0 END"""))
def quota_sample(t):
    return A.quota_sample(t.games(), "season", ["game_date", "game_id"], 100, [1996, 1997, 1998])


@query("date_windows", "window_start:t window_end:t n:b", over("games", """
 SELECT w AS window_start, LEAST(w + 13, DATE '1997-12-31') AS window_end, COUNT(game_id) AS n FROM (SELECT CAST(UNNEST(GENERATE_SERIES(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 14 DAY)) AS DATE) AS w) s
 LEFT JOIN games ON game_date BETWEEN w AND LEAST(w + 13, DATE '1997-12-31') GROUP BY 1, 2"""))
def date_windows(t):
    w = A.date_windows(t.spark, "1997-01-01", "1997-12-31", 14)
    days = w.select("*", F.explode(F.sequence("window_start", "window_end")).alias("game_date"))
    return days.join(t.games().select("game_date", "game_id"), "game_date", "left").groupBy("window_start", "window_end").agg(F.count("game_id").alias("n"))


@query("prediction_merge", "game_id:b p_market:d p_form:d p_prior:d p_mean:d", over("pw", """
 SELECT game_id, p_market, p_form, CASE WHEN season >= 1997 THEN p_prior ELSE p_form END AS p_prior, (p_market + p_form + CASE WHEN season >= 1997 THEN p_prior ELSE p_form END) / 3e0 AS p_mean
 FROM pw WHERE game_id % 3 <> 0"""))
def prediction_merge(t):
    p = t.preds()

    def model(name):
        return p.filter(F.col("model_id") == name).select("game_id", "season", F.col("p").alias(f"p_{name}"))

    both = model("market").join(model("form").filter("game_id % 3 <> 0"), ["game_id", "season"])
    out = both.join(model("prior").filter("season >= 1997"), ["game_id", "season"], "left")
    out = out.withColumn("p_prior", F.coalesce("p_prior", "p_form"))
    return out.withColumn("p_mean", (F.col("p_market") + F.col("p_form") + F.col("p_prior")) / 3.0)
