"""Source, sink and document queries."""

from pyspark.sql import functions as F, types as T

from boutline.functions.clocks import yards_to_endzone
from boutline.operators import aggregates as A, states as X
from boutline.plans.oracle import over
from boutline.plans.registry import query
from boutline.session import scratch_path, stored
from boutline.sources import documents as D, readers as R

GAME_COLS = "game_id:b season:b home:b away:b margin:d home_win:b"
GAME_SQL = over("games", "SELECT game_id, season, home, away, margin, home_win FROM games")
GAME_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("game_id", T.LongType()), ("season", T.IntegerType()), ("home", T.LongType()), ("away", T.LongType()),
    ("margin", T.DoubleType()), ("home_win", T.IntegerType()))])


def _games(t):
    return t.games().select(*[f.name for f in GAME_SCHEMA])


@query("csv_round_trip", GAME_COLS, GAME_SQL)
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    R.write_csv(_games(t), path)
    return R.read_first(t.spark, [path + "-missing", path], GAME_SCHEMA)


@query("json_round_trip", GAME_COLS, GAME_SQL)
def json_round_trip(t):
    path = scratch_path(t.spark, "json")
    R.write_json(_games(t), path)
    return t.spark.read.schema(GAME_SCHEMA).json(path)


@query("table_replace", GAME_COLS + " extra:s", over("games", "SELECT game_id, season, home, away, margin, home_win, CAST(NULL AS VARCHAR) AS extra FROM games"))
def table_replace(t):
    path = scratch_path(t.spark, "table")
    R.write_table(_games(t).limit(1), path)
    R.write_table(_games(t), path, ["season"])
    wide = T.StructType([*GAME_SCHEMA.fields, T.StructField("extra", T.StringType())])
    return R.align_columns(R.read_columns(t.spark, path, [f.name for f in GAME_SCHEMA]), wide)


@query("partition_replace", "game_id:b season:b margin:d", over("games", "SELECT game_id, season, CASE WHEN season = 1998 THEN margin + 100 ELSE margin END AS margin FROM games"))
def partition_replace(t):
    path = scratch_path(t.spark, "parts")
    g = t.games().select("game_id", "season", "margin")
    R.write_table(g, path, ["season"])
    R.replace_partitions(g.filter("season = 1998").withColumn("margin", F.col("margin") + 100), path, ["season"])
    return t.spark.read.parquet(path)


@query("snapshot_provenance", "s_suppkey:b source:s has_path:b has_time:b", "SELECT s_suppkey, 'supplier' AS source, 1 AS has_path, 1 AS has_time FROM supplier")
def snapshot_provenance(t):
    df = R.with_provenance(t.read("supplier"), "supplier")
    return df.select("s_suppkey", "source", F.col("raw_path").endswith("supplier.parquet").cast("int").alias("has_path"),
                     F.col("fetched_at").isNotNull().cast("int").alias("has_time"))


@query("latest_snapshot", "game_id:b margin:d file_name:s", over("games", "SELECT game_id, margin + 1 AS margin, 'taken-2' AS file_name FROM games"))
def latest_snapshot(t):
    path = scratch_path(t.spark, "snaps")
    g = stored(t.games().select("game_id", "margin"), "games")  # worked out once for both snapshots
    for name, add in (("taken-1", 0), ("taken-2", 1)):
        g.withColumn("margin", F.col("margin") + add).write.parquet(f"{path}/{name}")
    return R.latest_snapshot(t.spark, path)


# ---------------------------------------------------------------- documents built from the tables

@query("scoreboard_documents", "game_id:s game_date:t status:s home:s away:s home_score:b away_score:b", over("games", """
 SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(timezone('America/New_York', timezone('UTC', CAST(game_date AS TIMESTAMP) + INTERVAL 2 HOUR)) AS DATE) AS game_date, s AS status, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away,
  CASE WHEN s IN ('live', 'final') THEN home_score END AS home_score, CASE WHEN s IN ('live', 'final') THEN away_score END AS away_score
 FROM (SELECT *, CASE game_id % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'live' WHEN 2 THEN 'postponed' ELSE 'scheduled' END AS s FROM games WHERE game_id % 10 <> 9) x"""))
def scoreboard_documents(t):
    k = F.col("game_id") % 4

    def comp(side):
        return F.struct(F.lit(side).alias("homeAway"), F.col(f"{side}_score").cast("int").cast("string").alias("score"),
                        F.struct(F.col(side).cast("string").alias("abbreviation"), F.col(side).cast("string").alias("displayName")).alias("team"))

    status = F.struct(F.struct(
        F.when(k == 0, "post").when(k == 1, "in").otherwise("pre").alias("state"),
        F.when(k == 2, "STATUS_RAIN_DELAY").otherwise("STATUS_X").alias("name"), F.lit("x").alias("shortDetail")).alias("type"))
    event = F.struct(
        F.col("game_id").cast("string").alias("id"), F.date_format(F.to_timestamp("game_date") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.array(F.struct(F.struct(F.when(F.col("game_id") % 10 == 9, "ALLSTAR").otherwise("STD").alias("abbreviation")).alias("type"),
                         status.alias("status"), F.array(comp("away"), comp("home")).alias("competitors"))).alias("competitions"))
    docs = t.games().select(F.to_json(F.struct(F.array(event).alias("events"))).alias("doc"))
    return D.flatten_scoreboard(docs)


def _box_docs(t):
    m = t.members().join(t.games().select("game_id", "home", "away"), "game_id")
    m = m.filter((F.col("entity") == F.col("home")) | (F.col("entity") == F.col("away")))
    player = F.struct(F.col("member").alias("playerId"), F.concat(F.lit("p"), F.col("member").cast("string")).alias("name"),
                      F.when(F.col("member") % 3 == 0, "G").when(F.col("member") % 3 == 1, "D").otherwise("F").alias("position"),
                      F.col("shots").cast("int").alias("goals"), F.col("points").cast("int").alias("points"),
                      F.concat(F.col("minutes").cast("int").cast("string"), F.lit(":30")).alias("toi"), F.col("points").cast("int").alias("shotsAgainst"))
    m = m.withColumns({"pl": player, "side": F.when(F.col("entity") == F.col("home"), "home").otherwise("away")})

    def unit(side, i):
        return F.collect_list(F.when((F.col("side") == side) & (F.col("member") % 3 == i), F.col("pl")))

    def team(side):
        return F.struct(F.first(F.col(side)).cast("string").alias("abbrev"), unit(side, 2).alias("forwards"), unit(side, 1).alias("defense"), unit(side, 0).alias("goalies"))

    return m.groupBy("game_id", "season").agg(team("home").alias("homeTeam"), team("away").alias("awayTeam")).select(
        F.to_json(F.struct(F.col("game_id").alias("id"), "season", "homeTeam", "awayTeam")).alias("doc"))


@query("boxscore_documents", "game_id:b team:s member:b side:s position:s is_goalie:b played:b goals:b points:b toi_seconds:b", over("games members", """
 SELECT m.game_id, CAST(m.entity AS VARCHAR) AS team, m.member, CASE WHEN m.entity = g.home THEN 'home' ELSE 'away' END AS side, CASE m.member % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE 'F' END AS position,
  CASE WHEN m.member % 3 = 0 THEN 1 ELSE 0 END AS is_goalie, 1 AS played, CAST(shots AS BIGINT) AS goals, CAST(points AS BIGINT) AS points, CAST(minutes AS BIGINT) * 60 + 30 AS toi_seconds
 FROM members m JOIN games g ON g.game_id = m.game_id AND m.entity IN (g.home, g.away)"""))
def boxscore_documents(t):
    roster, stats = D.flatten_boxscore(_box_docs(t))
    return roster.join(stats, ["game_id", "season", "team", "member"])


@query("schedule_documents", "game_id:b game_date:t game_type:s home:b away:b home_score:b detailed:s", over("games", """
 SELECT game_id, game_date, 'R' AS game_type, home, away, CAST(home_score AS BIGINT) AS home_score, league AS detailed FROM games"""))
def schedule_documents(t):
    def team(side):
        return F.struct(F.col(f"{side}_score").cast("int").alias("score"), F.struct(F.col(side).alias("id")).alias("team"))

    game = F.struct(F.col("game_id").alias("gamePk"), F.lit("R").alias("gameType"), F.col("game_date").cast("string").alias("gameDate"),
                    F.struct(F.col("league").alias("detailedState"), F.lit("Final").alias("abstractGameState")).alias("status"),
                    F.struct(team("home").alias("home"), team("away").alias("away")).alias("teams"))
    docs = t.games().select(F.to_json(F.struct(F.array(F.struct(F.col("game_date").cast("string").alias("date"), F.array(game).alias("games"))).alias("dates"))).alias("doc"))
    return D.flatten_schedule(docs)


def _split_docs(t):
    blob = F.to_json(F.struct("points", "minutes", F.struct(F.col("shots").alias("taken")).alias("shots")))
    split = F.struct(F.col("season").cast("string").alias("season"), F.when(F.col("member") % 4 == 0, "S").otherwise("R").alias("gameType"),
                     F.struct(F.col("member").alias("id")).alias("player"), F.struct(F.col("entity").alias("id")).alias("team"),
                     F.struct(F.col("game_id").alias("gamePk")).alias("game"), blob.alias("stat"))
    return (t.members().groupBy("game_id", "entity").agg(F.collect_list(split).alias("splits"))
            .select(F.to_json(F.struct(F.array(F.struct(F.lit("season").alias("type"), "splits"), F.struct(F.lit("gameLog").alias("type"), "splits")).alias("stats"))).alias("doc")))


FIELDS = {"points": "points", "minutes": "minutes", "taken": "shots.taken"}


@query("stat_split_documents", "season:b member:b team:b game_id:b points:d minutes:d taken:d", over("members", "SELECT season, member, entity AS team, game_id, points, minutes, shots AS taken FROM members"))
def stat_split_documents(t):
    return D.flatten_stat_splits(_split_docs(t), "season", FIELDS)


@query("game_log_documents", "member:b team:b game_id:b points:d taken:d", over("members", "SELECT member, entity AS team, game_id, points, shots AS taken FROM members WHERE member % 4 <> 0"))
def game_log_documents(t):
    return D.flatten_game_logs(_split_docs(t), FIELDS)


@query("standings_documents", "division:s entity:b name:s wins:b losses:b win_pct:d differential:d", over("elog dim", """
 SELECT d.division, d.entity, d.name, s.w AS wins, s.l AS losses, CAST(s.w AS DOUBLE) / (s.w + s.l) AS win_pct, s.f - s.a AS differential FROM dim d JOIN
 (SELECT entity, SUM(win) AS w, SUM(1 - win) AS l, SUM(score) AS f, SUM(opp_score) AS a FROM elog GROUP BY 1) s ON s.entity = d.entity"""))
def standings_documents(t):
    s = t.log().groupBy("entity").agg(F.sum("win").cast("int").alias("wins"), F.sum(1 - F.col("win")).cast("int").alias("losses"),
                                      F.sum("score").alias("runsScored"), F.sum("opp_score").alias("runsAllowed")).join(t.dim(), "entity")
    rec = F.struct(F.struct(F.col("entity").alias("id"), "name").alias("team"), "wins", "losses", "runsScored", "runsAllowed")
    docs = s.select(F.to_json(F.struct(F.array(F.struct("division", F.array(rec).alias("teamRecords"))).alias("records"))).alias("doc"))
    return D.flatten_standings(docs)


PL = """SELECT game_id, day, event_id, ts, seq, CASE WHEN event_id % 37 = 0 THEN NULL ELSE home_score END AS hs, away_score AS aws, CASE WHEN event_id % 41 = 0 THEN NULL ELSE 1 + seq % 5 END AS period,
 CAST(event_id % 12 AS VARCHAR) || ':' || LPAD(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock, event_type FROM states"""


def _play_docs(t):
    e = F.col("event_id")
    s = t.states().withColumns({"hs": F.when(e % 37 != 0, F.col("home_score")), "period": F.when(e % 41 != 0, 1 + F.col("seq") % 5),
                                "clock": F.concat((e % 12).cast("string"), F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0"))})
    play = F.struct(e.cast("string").alias("id"), F.struct(F.col("period").cast("int").alias("number"), F.lit("x").alias("type")).alias("period"),
                    F.struct(F.col("clock").alias("displayValue")).alias("clock"), F.col("hs").cast("int").alias("homeScore"), F.col("away_score").cast("int").alias("awayScore"))
    wp = F.struct(e.cast("string").alias("playId"), (F.col("value") / 1000.0).alias("homeWinPercentage"))
    day = s.groupBy("game_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", play.alias("p")))), lambda x: x["p"]).alias("plays"),
                                          F.collect_list(F.when(e % 3 == 0, wp)).alias("winprobability"))
    top = F.col("game_id") % 2 == 0
    drive = F.array(F.struct("plays"))
    return day.select("game_id", "day", F.to_json(F.struct(
        F.col("game_id").cast("string").alias("id"), F.when(top, F.col("plays")).alias("plays"),
        F.when(~top, F.struct(F.when(F.col("game_id") % 3 == 0, drive).alias("previous"), F.when(F.col("game_id") % 3 != 0, drive).alias("current"))).alias("drives"),
        "winprobability")).alias("doc"))


def _plays(t):
    """Flat plays with an order over the whole contest: the document's day, then its place in it."""
    docs = _play_docs(t).select("doc")
    return D.flatten_plays(docs).withColumn("ord", F.col("play_id").cast("long"))


@query("play_documents", "game_id:s play_id:b period:b clock:s home_score:b away_score:b external_wp:d", over("states", f"""
 SELECT CAST(game_id AS VARCHAR) AS game_id, event_id AS play_id, period, clock, hs AS home_score, aws AS away_score, CASE WHEN event_id % 3 = 0 THEN v / 1000e0 END AS external_wp
 FROM ({PL.replace('event_type FROM', 'event_type, value AS v FROM')}) x"""))
def play_documents(t):
    return _plays(t)


@query("snapshots", "game_id:s play_id:b period:b frac:d margin:b home_won:b external_wp:d yards:b", over("states", f"""
 SELECT CAST(p.game_id AS VARCHAR) AS game_id, p.event_id AS play_id, period, CASE WHEN period > 4 THEN 0e0 ELSE GREATEST(0e0, LEAST(1e0, 1e0 - ((period - 1) * 720e0 + GREATEST(0e0, LEAST(720e0, 720e0 - ((event_id % 12) * 60 + event_id % 60)))) / 2880e0)) END AS frac,
  hs - aws AS margin, CASE WHEN f.h > f.a THEN 1 ELSE 0 END AS home_won, CASE WHEN event_id % 3 = 0 THEN v / 1000e0 END AS external_wp,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 100 - LEAST(100, event_id % 120) ELSE LEAST(100, event_id % 120) END AS yards
 FROM q p JOIN f ON f.game_id = p.game_id WHERE hs IS NOT NULL AND period IS NOT NULL AND f.h <> f.a""",
    q=PL.replace('event_type FROM', 'event_type, value AS v FROM'),
    f="SELECT game_id, ARG_MAX(hs, event_id) FILTER (hs IS NOT NULL) AS h, ARG_MAX(aws, event_id) AS a FROM q GROUP BY 1"))
def snapshots(t):
    s = X.snapshots(_plays(t), "nba")
    e = F.col("play_id").cast("long")
    own = F.when(e % 4 != 0, e % 4 == 1)
    return s.withColumn("yards", yards_to_endzone(e % 120, own))


@query("situation_documents", "game_id:s play_index:b play_id:b sequence_number:b period:b clock_seconds:d frac:d home_score:b away_score:b margin:b home_won:b "
       "external_wp:d offense_is_home:b offense_team_id:s down:b distance:b yard_line:b yards_to_endzone:b is_turnover:b play_type:s down_distance_text:s", over("states", f"""
 SELECT CAST(game_id AS VARCHAR) AS game_id, ROW_NUMBER() OVER (PARTITION BY game_id, day ORDER BY seq) - 1 AS play_index, event_id AS play_id, seq AS sequence_number, period,
  ((event_id % 12) * 60 + event_id % 60) AS clock_seconds, CASE WHEN period > 4 THEN 0e0 ELSE 1e0 - ((period - 1) * 900e0 + 900e0 - ((event_id % 12) * 60 + event_id % 60)) / 3600e0 END AS frac,
  hs AS home_score, aws AS away_score, hs - aws AS margin, CASE WHEN game_id % 7 > DAY(day) % 7 THEN 1 ELSE 0 END AS home_won, CASE WHEN event_id % 3 = 0 THEN v / 1000e0 END AS external_wp,
  CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END END AS offense_is_home, CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 4 = 1 THEN 'H' ELSE 'A' END || game_id END AS offense_team_id,
  NULLIF(event_id % 5, 0) AS down, event_id % 11 AS distance, event_id % 100 AS yard_line, 100 - event_id % 100 AS yards_to_endzone, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_turnover,
  event_type AS play_type, CASE WHEN event_id % 6 > 0 THEN 'start ' || event_id ELSE 'end ' || event_id END AS down_distance_text
 FROM ({PL.replace('event_type FROM', 'event_type, value AS v FROM')}) x WHERE hs IS NOT NULL AND period IS NOT NULL AND game_id % 7 <> DAY(day) % 7"""))
def situation_documents(t):
    e, g = F.col("event_id"), F.col("game_id").cast("string")
    s = t.states().withColumns({"hs": F.when(e % 37 != 0, F.col("home_score")), "period": F.when(e % 41 != 0, 1 + F.col("seq") % 5),
                                "clock": F.concat((e % 12).cast("string"), F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0"))})
    own = F.when(e % 4 > 0, F.concat(F.when(e % 4 == 1, "H").otherwise("A"), g))
    start = F.struct(F.struct(own.alias("id")).alias("team"), F.when(e % 5 != 0, e % 5).cast("int").alias("down"), (e % 11).cast("int").alias("distance"), (e % 100).cast("int").alias("yardLine"),
                     (100 - e % 100).cast("int").alias("yardsToEndzone"), F.when(e % 6 > 0, F.concat(F.lit("start "), e.cast("string"))).alias("downDistanceText"))
    play = F.struct(e.cast("string").alias("id"), F.struct(F.col("period").cast("int").alias("number")).alias("period"), F.struct(F.col("clock").alias("displayValue")).alias("clock"),
                    F.col("hs").cast("int").alias("homeScore"), F.col("away_score").cast("int").alias("awayScore"), F.col("seq").cast("string").alias("sequenceNumber"),
                    (F.col("event_type") == "error").alias("isTurnover"), F.struct(F.col("event_type").alias("text")).alias("type"), start.alias("start"),
                    F.struct(F.concat(F.lit("end "), e.cast("string")).alias("downDistanceText")).alias("end"))
    wp = F.struct(e.cast("string").alias("playId"), (F.col("value") / 1000.0).alias("homeWinPercentage"))
    day = s.groupBy("game_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", play.alias("p")))), lambda x: x["p"]).alias("plays"),
                                          F.collect_list(F.when(e % 3 == 0, wp)).alias("winprobability"))

    def side(name, score):
        return F.struct(F.lit(name).alias("homeAway"), F.struct(F.concat(F.lit(name[0].upper()), g).alias("id")).alias("team"), score.cast("string").alias("score"))

    header = F.struct(F.array(F.struct(F.array(side("away", F.dayofmonth("day") % 7), side("home", F.col("game_id") % 7)).alias("competitors"))).alias("competitions"))
    docs = day.select(F.to_json(F.struct(g.alias("id"), header.alias("header"), "plays", "winprobability")).alias("doc"))
    return D.situation_snapshots(docs)


@query("pivot_box", "game_id:b entity:b points:d minutes:d shots:d", over("members", "SELECT game_id, entity, SUM(points) AS points, SUM(minutes) AS minutes, CASE WHEN entity % 2 = 0 THEN SUM(shots) END AS shots FROM members GROUP BY 1, 2"))
def pivot_box(t):
    sums = t.members().groupBy("game_id", "entity").agg(*[F.sum(c).alias(c) for c in ("points", "minutes", "shots")])
    names = ["points", "minutes", "shots"]
    long = sums.select("game_id", "entity", F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names])))
    return D.pivot_box(long.filter("stat <> 'shots' or entity % 2 = 0"), ["game_id", "entity"], names)


@query("pbp_columns", "event_id:b event_type:s", "SELECT event_id, event_type FROM events WHERE value > 50")
def pbp_columns(t):
    return R.read_columns(t.spark, f"{t.folder}/events.parquet", ["event_id", "event_type", "value"]).where("value > 50")


@query("upsert_by_date", "game_id:b margin:d game_date:t", over("games", "SELECT game_id, CASE WHEN game_id % 3 = 0 THEN -1 ELSE margin END AS margin, CASE WHEN game_id % 3 = 0 THEN game_date + 5 ELSE game_date END AS game_date FROM games"))
def upsert_by_date(t):
    g = t.games().select("game_id", "margin", "game_date")
    new = g.filter("game_id % 3 = 0").withColumns({"margin": F.lit(-1.0), "game_date": F.date_add("game_date", 5)})
    return A.upsert(g, new, ["game_id"], "game_date")
