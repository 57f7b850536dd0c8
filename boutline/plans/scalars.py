"""Scalar function queries."""

from pyspark.sql import functions as F

from boutline.functions import calendar as K, cleaning as L, clocks as C, features as X, geo, odds as O, status as S
from boutline.operators import joins as J
from boutline.plans.history import FORM
from boutline.plans.oracle import over
from boutline.plans.registry import query

RAW = """CASE event_id % 8 WHEN 0 THEN ' na ' WHEN 1 THEN '' WHEN 2 THEN 'N/A' WHEN 3 THEN '-' WHEN 4 THEN 'null'
 WHEN 5 THEN 'x' || CAST(event_id AS {s}) WHEN 6 THEN CAST(event_id AS {s}) ELSE ' ' || CAST(event_id AS {s}) || '.75 ' END"""
CLEAN = "CASE WHEN UPPER(TRIM(raw)) IN ('', 'NA', 'N/A', 'NULL', '-') THEN NULL ELSE TRIM(raw) END"


@query("clean_casts", "event_id:b cleaned:s num:d whole:b flag:b ratio:d ratio0:d finite_ratio:d", f"""
 SELECT event_id, c AS cleaned, TRY_CAST(c AS DOUBLE) AS num, CAST(TRUNC(TRY_CAST(c AS DOUBLE)) AS BIGINT) AS whole,
  CASE WHEN c IS NULL THEN NULL WHEN UPPER(c) IN ('TRUE', '1', 'YES') THEN 1 ELSE 0 END AS flag,
  value / NULLIF(event_id % 3, 0) AS ratio, COALESCE(value / NULLIF(event_id % 3, 0), 0) AS ratio0,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS finite_ratio
 FROM (SELECT *, {CLEAN} AS c FROM (SELECT *, {RAW.format(s='VARCHAR')} AS raw FROM events) x) y""")
def clean_casts(t):
    ev = t.read("events").withColumn("raw", F.expr(RAW.format(s="STRING")))
    d = F.col("event_id") % 3
    return ev.select("event_id", L.clean("raw").alias("cleaned"), L.as_float("raw").alias("num"), L.as_int("raw").alias("whole"),
                     L.as_bool_int("raw").alias("flag"), L.safe_div("value", d).alias("ratio"),
                     L.safe_div("value", d, 0.0).alias("ratio0"),
                     L.finite(F.when(d == 0, float("nan")).otherwise(F.col("value"))).alias("finite_ratio"))


CLK = """CASE l_partkey % 5 WHEN 0 THEN 'bad' WHEN 1 THEN CAST(l_linenumber AS {s}) || '.5' ELSE
 CAST(l_linenumber + 2 AS {s}) || ':' || CAST(CAST(l_quantity AS INT) AS {s}) END"""


@query("clocks", "l_orderkey:b l_partkey:b secs:d minutes:d nba:d nhl:d inning:d label_nba:s label_mlb:s made:b attempted:b n:b", f"""
 SELECT l_orderkey, l_partkey, secs, secs / 60e0 AS minutes,
  CASE WHEN p > 4 THEN 0e0 ELSE GREATEST(0e0, LEAST(1e0, 1e0 - ((p - 1) * 720e0 + CASE WHEN secs IS NULL THEN 0e0 ELSE GREATEST(0e0, LEAST(720e0, 720e0 - secs)) END) / 2880e0)) END AS nba,
  CASE WHEN p > 3 THEN 0e0 ELSE GREATEST(0e0, LEAST(1e0, 1e0 - ((p - 1) * 1200e0 + CASE WHEN secs IS NULL THEN 0e0 ELSE GREATEST(0e0, LEAST(1200e0, secs)) END) / 3600e0)) END AS nhl,
  GREATEST(0e0, LEAST(1e0, 1e0 - ((p - 1) * 2 + CASE WHEN l_tax < 0.04 THEN 0 ELSE 1 END) / 18e0)) AS inning,
  CASE WHEN p > 4 THEN 'OT' || CAST(p - 4 AS VARCHAR) ELSE 'Q' || CAST(p AS VARCHAR) END AS label_nba,
  CASE WHEN l_tax < 0.04 THEN 'T' ELSE 'B' END || CAST(p AS VARCHAR) AS label_mlb,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS made, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey END AS attempted, n
 FROM (SELECT l_orderkey, l_partkey, l_linenumber AS p, l_tax, l_quantity, COUNT(*) AS n,
   CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN l_linenumber + 0.5e0 ELSE (l_linenumber + 2) * 60e0 + TRUNC(l_quantity) END AS secs
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber, l_tax, l_quantity) x""")
def clocks(t):
    li = (t.read("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_quantity")
          .agg(F.count(F.lit(1)).alias("n")).withColumn("clk", F.expr(CLK.format(s="STRING"))))
    secs, p, top = C.clock_seconds("clk"), F.col("l_linenumber"), F.col("l_tax") < 0.04
    pair = F.when(F.col("l_partkey") % 4 == 0, "NA").otherwise(
        F.concat_ws("-", F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")))
    made, attempted = L.split_pair(pair)
    return li.select(
        "l_orderkey", "l_partkey", "n", secs.alias("secs"), C.minutes_decimal("clk").alias("minutes"),
        C.frac_remaining_clock("nba", p, secs).alias("nba"), C.frac_remaining_clock("nhl", p, secs).alias("nhl"),
        C.frac_remaining_innings(p, top).alias("inning"), C.period_label(F.lit("nba"), p).alias("label_nba"),
        C.period_label(F.lit("mlb"), p, F.when(top, "top").otherwise("Bottom")).alias("label_mlb"),
        made.alias("made"), attempted.alias("attempted"))


@query("norm_keys", "doc_id:b key_length:b key_md5:s words:b", """
 SELECT doc_id, LENGTH(k) AS key_length, MD5(k) AS key_md5, LENGTH(w) AS words FROM (SELECT doc_id,
  REGEXP_REPLACE(LOWER(STRIP_ACCENTS(text)), '[^a-z0-9]', '', 'g') AS k,
  TRIM(REGEXP_REPLACE(LOWER(text), '[^a-z0-9]+', ' ', 'g')) AS w FROM documents) x""")
def norm_keys(t):
    key = L.norm_key("text")
    return t.read("documents").select("doc_id", F.length(key).alias("key_length"), F.md5(key).alias("key_md5"),
                                      F.length(L.norm_words("text")).alias("words"))


@query("canonical_codes", "o_orderkey:b code:s canonical:s", """
 SELECT o_orderkey, code, CASE WHEN YEAR(o_orderdate) < 1998 AND code IN ('N3', 'NAT3') THEN 'OLD_3' ELSE COALESCE(n_name, code) END AS canonical
 FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'NAT' ELSE 'X' END || CAST(c_nationkey AS VARCHAR) AS code
  FROM orders JOIN customer ON o_custkey = c_custkey) x
 LEFT JOIN nation ON code IN ('N' || CAST(n_nationkey AS VARCHAR), 'NAT' || CAST(n_nationkey AS VARCHAR))""")
def canonical_codes(t):
    key = F.col("n_nationkey").cast("string")
    alias = t.read("nation").select(F.col("n_name").alias("canonical"), F.concat(F.lit(" n"), key, F.lit("|nat"), key).alias("aliases"))
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "N").when(F.col("o_orderkey") % 3 == 1, "NAT").otherwise("X")
    rows = rows.withColumn("code", F.concat(kind, F.col("c_nationkey").cast("string")))
    return J.canonicalize(rows, "code", alias, era=(F.year("o_orderdate") < 1998, ["N3", "NAT3"], "OLD_3"))


@query("resolve_entity", "c_custkey:b query_text:s entity:b how:s", over("dim", """
 , q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 130 AS VARCHAR) WHEN 1 THEN ' SUPPLIER#' || LPAD(CAST(c_custkey % 130 AS VARCHAR), 9, '0')
   WHEN 2 THEN 'supplier#' || LPAD(CAST(c_custkey % 10 AS VARCHAR), 8, '0') ELSE c_mktsegment END AS query_text FROM customer),
 k AS (SELECT *, TRIM(REGEXP_REPLACE(LOWER(query_text), '[^a-z0-9]+', ' ', 'g')) AS nq FROM q),
 d AS (SELECT entity, CAST(entity AS VARCHAR) AS code, TRIM(REGEXP_REPLACE(LOWER(name), '[^a-z0-9]+', ' ', 'g')) AS nn FROM dim),
 p AS (SELECT k.c_custkey, COUNT(*) AS n, MIN(d.entity) AS e FROM k JOIN d ON starts_with(d.nn, k.nq) AND k.nq <> '' GROUP BY 1)
 SELECT k.c_custkey, k.query_text, COALESCE(c.entity, x.entity, CASE WHEN p.n = 1 THEN p.e END) AS entity,
  CASE WHEN c.entity IS NOT NULL THEN 'code' WHEN x.entity IS NOT NULL THEN 'name' WHEN p.n = 1 THEN 'prefix' END AS how
 FROM k LEFT JOIN d c ON c.code = TRIM(LOWER(k.query_text)) LEFT JOIN d x ON x.nn = k.nq LEFT JOIN p ON p.c_custkey = k.c_custkey"""))
def resolve_entity(t):
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, (k % 130).cast("string"))
            .when(k % 4 == 1, F.concat(F.lit(" SUPPLIER#"), F.lpad((k % 130).cast("string"), 9, "0")))
            .when(k % 4 == 2, F.concat(F.lit("supplier#"), F.lpad((k % 10).cast("string"), 8, "0")))
            .otherwise(F.col("c_mktsegment")))
    return J.resolve_entity(t.read("customer").select("c_custkey", text.alias("query_text")), "query_text", t.dim())


@query("local_times", "event_id:b slate:t utc_off:d start:ts", over("dim", """
 SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS slate,
  epoch(noon - timezone('UTC', timezone(d.tz, noon))) / 3600e0 AS utc_off,
  CASE WHEN event_id % 5 <> 0 THEN timezone('UTC', timezone(d.tz, DATE_TRUNC('minute', ts))) END AS start
 FROM (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS noon FROM events) e JOIN dim d ON d.entity = user_id % 10"""))
def local_times(t):
    ev = t.read("events").join(t.dim().select("entity", "tz"), F.col("user_id") % 10 == F.col("entity"))
    return ev.select("event_id", geo.local_date("ts", "America/New_York").alias("slate"),
                     geo.utc_offset_hours("tz", F.to_date("ts")).alias("utc_off"),
                     geo.start_utc(F.date_trunc("minute", "ts"), "tz", F.col("event_id") % 5 == 0).alias("start"))


def _state_sql(league, m="MONTH(d)", md="(MONTH(d) * 100 + DAY(d))"):
    return {
        "nhl": f"CASE WHEN {md} >= 701 AND {md} < 915 THEN 'offseason' WHEN {m} = 9 THEN 'preseason' WHEN {m} IN (5, 6) THEN 'playoffs' ELSE 'regular' END",
        "nba": f"CASE WHEN {md} >= 701 AND {md} < 920 THEN 'offseason' WHEN {md} >= 920 AND {md} < 1015 THEN 'preseason' WHEN {m} IN (5, 6) THEN 'playoffs' ELSE 'regular' END",
        "mlb": f"CASE WHEN {m} IN (11, 12, 1, 2) THEN 'offseason' WHEN {md} BETWEEN 301 AND 319 THEN 'preseason' WHEN {m} = 10 THEN 'playoffs' ELSE 'regular' END",
        "nfl": f"CASE WHEN {md} >= 301 AND {md} < 805 THEN 'offseason' WHEN {m} = 8 THEN 'preseason' WHEN {m} IN (1, 2) THEN 'playoffs' ELSE 'regular' END"}[league]


@query("calendar_phases", "o_orderkey:b label:s parsed:b season:b nhl:s nba:s mlb:s nfl:s since:b until:b", f"""
 SELECT o_orderkey, CAST(s AS VARCHAR) || '-' || LPAD(CAST((s + 1) % 100 AS VARCHAR), 2, '0') AS label, s + 1 AS parsed, s AS season,
  {", ".join(f"{_state_sql(g)} AS {g}" for g in ("nhl", "nba", "mlb", "nfl"))},
  CAST(CASE WHEN YEAR(d) = s + 1 THEN date_diff('day', MAKE_DATE(s + 1, 1, 1), d) ELSE date_diff('day', MAKE_DATE(s, 1, 1), d) END AS BIGINT) AS since,
  CAST(CASE WHEN YEAR(d) = s + 1 THEN date_diff('day', d, MAKE_DATE(s + 2, 1, 1)) ELSE date_diff('day', d, MAKE_DATE(s + 1, 1, 1)) END AS BIGINT) AS until
 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, YEAR(o_orderdate) - CASE WHEN MONTH(o_orderdate) >= 7 THEN 0 ELSE 1 END AS s FROM orders) x""")
def calendar_phases(t):
    o = t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = K.season_of("d")
    key = F.col("o_orderkey") % 4
    text = (F.when(key == 0, K.season_label(s)).when(key == 1, F.concat(s.cast("string"), (s + 1).cast("string")))
            .when(key == 2, F.concat(s.cast("string"), F.lpad(((s + 1) % 100).cast("string"), 2, "0")))
            .otherwise((s + 1).cast("string")))
    since, until = K.deadline_days("d", s)
    return o.select("o_orderkey", K.season_label(s).alias("label"), K.parse_season(text).alias("parsed"), s.alias("season"),
                    *[K.season_state("d", g).alias(g) for g in ("nhl", "nba", "mlb", "nfl")],
                    since.alias("since"), until.alias("until"))


SCHEDULE_SQL = """SELECT o_orderkey AS game_id, CASE o_orderstatus WHEN 'F' THEN 'post' WHEN 'O' THEN 'in' ELSE 'pre' END AS state,
 CASE WHEN o_orderkey % 11 = 0 THEN 'STATUS_POSTPONED' WHEN o_orderkey % 13 = 0 THEN 'STATUS_RAIN_DELAY' ELSE 'STATUS_X' END AS type_name,
 CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Live' ELSE 'Preview' END AS abstract,
 CASE WHEN o_orderkey % 7 = 0 THEN 'Warmup' WHEN o_orderkey % 9 = 0 THEN 'Delayed Start' ELSE 'In Progress' END AS detailed,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'PPD' WHEN '2-HIGH' THEN 'CRIT' WHEN '3-MEDIUM' THEN 'OFF' ELSE 'FUT' END AS code,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Game Postponed' ELSE 'Halftime' END AS free_text,
 CASE WHEN o_orderkey % 6 = 0 THEN 'PRE' WHEN o_orderkey % 6 = 1 THEN 'POST' WHEN o_orderkey % 6 = 2 THEN 'ALLSTAR' ELSE 'REG' END AS game_type,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 17 END AS home_score, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 19 END AS away_score,
 o_orderkey % 23 <> 0 AS known, CAST(o_orderkey % 14 AS INT) AS rest, CASE o_orderkey % 4 WHEN 0 THEN 'dome' WHEN 1 THEN 'Open' WHEN 2 THEN 'outdoors' END AS roof,
 CAST(o_orderkey % 80 AS INT) AS temp, CAST(o_orderkey % 21 AS INT) AS wind, CAST(o_orderkey % 24 AS INT) AS hour, {weekday} AS weekday, o_orderdate FROM orders"""


@query("status_rules", "game_id:b s1:s s2:s s3:s s4:s shown:b", f"""
 SELECT game_id, s1, CASE WHEN detailed = 'Delayed Start' THEN 'postponed' WHEN abstract = 'Final' THEN 'final'
   WHEN abstract = 'Live' AND detailed = 'Warmup' THEN 'scheduled' WHEN abstract = 'Live' THEN 'live' ELSE 'scheduled' END AS s2,
  CASE WHEN free_text = 'Game Postponed' THEN 'postponed' WHEN free_text = 'Halftime' THEN 'live' WHEN home_score IS NOT NULL THEN 'final' ELSE 'scheduled' END AS s3,
  CASE code WHEN 'PPD' THEN 'postponed' WHEN 'CRIT' THEN 'live' WHEN 'OFF' THEN 'final' ELSE 'scheduled' END AS s4,
  CASE WHEN s1 IN ('live', 'final') THEN home_score END AS shown
 FROM (SELECT *, CASE WHEN type_name <> 'STATUS_X' THEN 'postponed' WHEN state = 'in' THEN 'live' WHEN state = 'post' THEN 'final' ELSE 'scheduled' END AS s1
  FROM ({SCHEDULE_SQL.format(weekday="''")}) a WHERE game_type <> 'ALLSTAR') b""")
def status_rules(t):
    t.read("orders").createOrReplaceTempView("boutline_orders")
    rows = t.spark.sql(SCHEDULE_SQL.format(weekday="''").replace("FROM orders", "FROM boutline_orders"))
    s1 = S.status_from_state("state", "type_name")
    return rows.filter("game_type <> 'ALLSTAR'").select(
        "game_id", s1.alias("s1"), S.status_from_detail("abstract", "detailed").alias("s2"),
        S.status_from_text("free_text", F.col("home_score").isNotNull()).alias("s3"),
        S.status_from_codes("code", F.lit(None)).alias("s4"), S.played_score("home_score", s1).alias("shown"))


@query("contest_flags", "game_id:b phase:s played:b unplayed:b tie:b home_win:b notes:s short_week:b post_bye:b dome:b bad_weather:b primetime:b thursday:b streak:b", f"""
 SELECT game_id, CASE WHEN game_type IN ('PRE', 'REG') THEN game_type ELSE 'POST' END AS phase, CASE WHEN home_score IS NULL THEN 0 ELSE 1 END AS played,
  CASE WHEN home_score IS NULL THEN 1 ELSE 0 END AS unplayed, CASE WHEN home_score = away_score THEN 1 ELSE 0 END AS tie,
  CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS home_win,
  NULLIF(CONCAT_WS(';', CASE WHEN home_score IS NULL THEN 'unplayed_or_missing_score' END, CASE WHEN home_score = away_score THEN 'tie_excluded_from_binary_home_win' END,
   CASE WHEN NOT known THEN 'unknown_team_alias' END, CASE WHEN game_type = 'PRE' THEN 'preseason_flagged_exclude_from_training' END), '') AS notes,
  CASE WHEN rest <= 4 THEN 1 ELSE 0 END AS short_week, CASE WHEN rest >= 10 THEN 1 ELSE 0 END AS post_bye,
  CASE WHEN roof IS NULL THEN NULL WHEN LOWER(roof) IN ('dome', 'closed') THEN 1 ELSE 0 END AS dome,
  CASE WHEN LOWER(roof) IN ('outdoors', 'open') AND (temp <= 35 OR wind >= 15) THEN 1 ELSE 0 END AS bad_weather,
  CASE WHEN hour IN (20, 21) THEN 1 ELSE 0 END AS primetime, CASE WHEN weekday = 'Thursday' THEN 1 ELSE 0 END AS thursday,
  CASE WHEN code = 'PPD' THEN rest ELSE -rest END AS streak
 FROM ({SCHEDULE_SQL.format(weekday="DAYNAME(o_orderdate)")}) a""")
def contest_flags(t):
    t.read("orders").createOrReplaceTempView("boutline_orders")
    rows = t.spark.sql(SCHEDULE_SQL.format(weekday="date_format(o_orderdate, 'EEEE')").replace("FROM orders", "FROM boutline_orders"))
    return rows.select("game_id", *[v.alias(k) for k, v in S.classify("game_type", "home_score", "away_score", "known").items()],
                       *[v.alias(k) for k, v in S.situation_flags("rest", "roof", "temp", "wind", "hour", "weekday").items()],
                       S.signed_streak(F.when(F.col("code") == "PPD", "W").otherwise("L"), "rest").alias("streak"))


@query("odds_math", "game_id:b ph:d pa:d devig:d spread_p:d fair:d logit:d back:d label:s elo_eq:d pythag:d ll:d brier:d", over("imp", f"""
 SELECT game_id, ph, pa, p AS devig, 1e0 / (1e0 + EXP(-spread_line / 13.45e0)) AS spread_p,
  CASE WHEN p >= 0.5e0 THEN -100e0 * p / (1e0 - p) ELSE 100e0 * (1e0 - p) / p END AS fair, LN(p / (1e0 - p)) AS logit, p AS back,
  CASE WHEN ABS(p - 0.5e0) >= 0.15e0 THEN 'high' WHEN ABS(p - 0.5e0) >= 0.07e0 THEN 'medium' ELSE 'low' END AS label,
  1500e0 + 400e0 * LOG10(p / (1e0 - p)) AS elo_eq, hs * hs / (hs * hs + aw * aw) AS pythag,
  -(home_win * LN(p) + (1 - home_win) * LN(1e0 - p)) AS ll, (p - home_win) * (p - home_win) AS brier
 FROM (SELECT i.*, ph / (ph + pa) AS p, g.home_score AS hs, g.away_score AS aw FROM imp i JOIN games g USING (game_id)) x"""))
def odds_math(t):
    o = t.odds().join(t.games().select("game_id", "home_score", "away_score"), "game_id")
    ph, pa = O.implied_prob("home_ml"), O.implied_prob("away_ml")
    p = F.col("devig")
    return (o.withColumns({"ph": ph, "pa": pa}).withColumn("devig", O.devig("ph", "pa")).withColumns({
        "spread_p": O.spread_prob("spread_line"), "fair": O.prob_to_odds(p), "logit": O.logit(p),
        "back": O.sigmoid(O.logit(p)), "label": J.confidence_label(p, [("high", 0.15), ("medium", 0.07)], "low"),
        "elo_eq": O.winpct_to_elo(p), "pythag": O.pythag("home_score", "away_score"),
        "ll": O.log_loss(p, "home_win"), "brier": O.brier(p, "home_win")}))


BOX = """SELECT l_orderkey AS game_id, l_suppkey AS entity, SUM(l_quantity) AS points, SUM(l_quantity) AS fgm, SUM(l_quantity) * 2 + COUNT(*) AS fga,
 SUM(l_linenumber) AS tpm, SUM(l_linenumber) * 2 AS tpa, COUNT(*) * 2 AS fta, COUNT(*) AS oreb, SUM(l_linenumber) AS dreb, MAX(l_linenumber) AS turnovers
 FROM lineitem GROUP BY l_orderkey, l_suppkey"""


@query("box_rates", "game_id:b entity:b possessions:d off_rating:d def_rating:d def_rating_opp:d efg:d three_rate:d reb_rate:d oreb_rate:d tov_rate:d", over("elog", """
 SELECT g.game_id, g.entity, b.poss AS possessions, 100e0 * b.points / NULLIF(b.poss, 0) AS off_rating, 100e0 * o.points / NULLIF(b.poss, 0) AS def_rating,
  100e0 * o.points / NULLIF(o.poss, 0) AS def_rating_opp, (b.fgm + 0.5e0 * b.tpm) / NULLIF(b.fga, 0) AS efg, b.tpa / NULLIF(b.fga, 0) AS three_rate,
  CAST(b.oreb + b.dreb AS DOUBLE) / (b.oreb + b.dreb + o.oreb + o.dreb) AS reb_rate, CAST(b.oreb AS DOUBLE) / (b.oreb + o.dreb) AS oreb_rate, b.turnovers / NULLIF(b.poss, 0) AS tov_rate
 FROM elog g JOIN bp b ON b.game_id = g.game_id AND b.entity = g.entity LEFT JOIN bp o ON o.game_id = g.game_id AND o.entity = g.opponent""",
    bx=BOX, bp="SELECT *, fga + 0.44e0 * fta + turnovers - oreb AS poss FROM bx"))
def box_rates(t):
    t.read("lineitem").createOrReplaceTempView("boutline_lineitem")
    box = t.spark.sql(BOX.replace("FROM lineitem", "FROM boutline_lineitem"))
    rows = J.opponent_stats(t.log().select("game_id", "entity", "opponent"), box, ["game_id"])
    c = F.col
    opp = c("opp_fga") + 0.44 * c("opp_fta") + c("opp_turnovers") - c("opp_oreb")
    return rows.withColumns(X.box_rates(c("points"), c("opp_points"), c("fgm"), c("fga"), c("tpm"), c("tpa"), c("fta"), c("oreb"), c("dreb"),
                                        c("opp_dreb"), c("oreb") + c("dreb"), c("opp_oreb") + c("opp_dreb"), c("turnovers"), opp))


@query("json_sums", "user_id:b k_sum:d k_missing:b n:b", """
 SELECT user_id, SUM(TRY_CAST(NULLIF(json_extract_string(props, '$.k'), '') AS DOUBLE)) AS k_sum,
  COUNT(*) - COUNT(TRY_CAST(NULLIF(json_extract_string(props, '$.k'), '') AS DOUBLE)) AS k_missing, COUNT(*) AS n FROM events GROUP BY 1""")
def json_sums(t):
    k = F.from_json("props", "k string").getField("k")
    num = F.nullif(k, F.lit("")).try_cast("double")
    return t.read("events").select("user_id", num.alias("k")).groupBy("user_id").agg(
        F.sum("k").alias("k_sum"), (F.count(F.lit(1)) - F.count("k")).alias("k_missing"), F.count(F.lit(1)).alias("n"))


@query("state_features", "event_id:b margin_scaled:d pregame_logit:d pregame_logit_decay:d offense_is_home:d field_position_home:d situation_known:d outs_known:d yards:b", over("states", """
 SELECT event_id, margin / SQRT(frac + 1e-6) AS margin_scaled, lg AS pregame_logit, lg * frac AS pregame_logit_decay,
  CASE WHEN off IS NULL THEN 0.5e0 WHEN off THEN 1e0 ELSE 0e0 END AS offense_is_home,
  CASE WHEN off IS NULL OR yds IS NULL THEN 0e0 WHEN off THEN 100e0 - yds ELSE yds - 100e0 END AS field_position_home,
  CASE WHEN off IS NOT NULL AND yds IS NOT NULL AND down IS NOT NULL THEN 1e0 ELSE 0e0 END AS situation_known,
  CASE WHEN event_id % 4 = 3 THEN 0e0 ELSE 1e0 END AS outs_known, yds AS yards
 FROM (SELECT *, CASE WHEN off IS NULL THEN NULL WHEN off THEN 100 - yl ELSE yl END AS yds FROM (SELECT *,
  CASE WHEN game_id % 3 = 0 THEN 0e0 ELSE LN((0.3e0 + (game_id % 5) / 10e0) / (0.7e0 - (game_id % 5) / 10e0)) END AS lg,
  CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE END AS off, LEAST(100, event_id % 110) AS yl,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 5 END AS down FROM states) x) y"""))
def state_features(t):
    s = t.states()
    off = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False)
    pre = F.when(F.col("game_id") % 3 != 0, 0.3 + (F.col("game_id") % 5) / 10.0)
    yards = C.yards_to_endzone(F.col("event_id") % 110, off)
    down = F.nullif(F.col("event_id") % 5, F.lit(0))
    outs = F.when(F.col("event_id") % 4 != 3, F.col("event_id") % 4)
    feats = X.state_features(F.col("margin"), "frac", pre, outs=outs, offense_is_home=off, down=down, yards=yards)
    return s.select("event_id", yards.alias("yards"), *[v.alias(k) for k, v in feats.items()])


@query("interactions", "game_id:b form_x_quality:d location_x_gap:d accel:d pressure:d deltas_sum:d", over("elog", """
 SELECT h.game_id, COALESCE(h.season_pct - a.season_pct, 0) * COALESCE(h.season_gd - a.season_gd, 0) AS form_x_quality,
  COALESCE(h.home_pct, 0) * 0e0 AS location_x_gap, COALESCE(h.last10_gd, 0) - COALESCE(h.season_gd, 0) AS accel,
  COALESCE(h.season_pct - a.season_pct, 0) * (1e0 - 0.1e0 * ABS(COALESCE(h.season_gd - a.season_gd, 0))) AS pressure,
  COALESCE(h.season_pct - a.season_pct, 0) + COALESCE(h.last10_pct - a.last10_pct, 0) AS deltas_sum
 FROM form h JOIN form a ON a.game_id = h.game_id AND h.is_home = 1 AND a.is_home = 0""", form=FORM))
def interactions(t):
    from boutline.operators import history as H

    rows = H.pivot_sides(H.form_features(t.log()), ["game_id"], ["season_pct", "season_gd", "last10_pct", "last10_gd", "home_pct"])
    rows = X.add_deltas(rows)
    return X.interactions(rows, {
        "form_x_quality": "diff_season_pct * diff_season_gd", "location_x_gap": "home_home_pct * never_built_column",
        "accel": "home_last10_gd - home_season_gd", "pressure": "diff_season_pct * (1 - 0.1 * abs(diff_season_gd))",
        "deltas_sum": "diff_season_pct + diff_last10_pct"})


@query("tz_travel", "game_id:b signed:d absolute:d miles:d", over("games dim", """
 SELECT game_id, ho - ao AS signed, ABS(ho - ao) AS absolute,
  2e0 * 3958.7613e0 * ASIN(SQRT(POWER(SIN((RADIANS(hl) - RADIANS(al)) / 2e0), 2) + COS(RADIANS(al)) * COS(RADIANS(hl)) * POWER(SIN((RADIANS(hn) - RADIANS(an)) / 2e0), 2))) AS miles
 FROM (SELECT g.game_id, epoch(noon - timezone('UTC', timezone(h.tz, noon))) / 3600e0 AS ho, epoch(noon - timezone('UTC', timezone(a.tz, noon))) / 3600e0 AS ao,
   h.lat AS hl, h.lon AS hn, a.lat AS al, a.lon AS an
  FROM (SELECT *, CAST(game_date AS TIMESTAMP) + INTERVAL 12 HOUR AS noon FROM games) g JOIN dim h ON h.entity = g.home JOIN dim a ON a.entity = g.away) x"""))
def tz_travel(t):
    rows = J.attach_sides(t.games(), t.dim().select("entity", "lat", "lon", "tz"))
    shift = geo.utc_offset_hours("home_tz", "game_date") - geo.utc_offset_hours("away_tz", "game_date")
    return rows.select("game_id", shift.alias("signed"), F.abs(shift).alias("absolute"),
                       geo.haversine("away_lat", "away_lon", "home_lat", "home_lon").alias("miles"))
