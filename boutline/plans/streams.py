"""Streaming queries; each is drained and its output compared with the batch answer."""

from pyspark.sql import functions as F

from boutline.operators import history as H, ratings as R
from boutline.plans.modelling import HI, LO, SURFACE, _surface
from boutline.plans.oracle import over
from boutline.plans.registry import query
from boutline.session import scratch_path, stored
from boutline.streaming import live as S


def _events(t):
    return S.file_stream(t.spark, t.folder, t.read("events").schema, "events.parquet")


def _timed(t):
    return _events(t).withColumn("ts", F.col("ts").cast("timestamp"))


def _shuffled_files(t, df, label, files=6, per_batch=2):
    """A stream of files that each hold contests of every season, in an order that has nothing to do with time."""
    feed = scratch_path(t.spark, label)
    part = F.pmod(F.xxhash64("game_id"), F.lit(files))
    df.withColumn("part", part).repartition(files, "part").write.partitionBy("part").parquet(feed)
    return S.file_stream(t.spark, feed, df.schema, files_per_batch=per_batch)


ANY_DAY = 40_000  # days: no final of the given tables is too late


@query("stream_win_probability", "event_id:b margin:b frac:d p:d", over("states", """
 SELECT event_id, margin, frac, LEAST(0.999e0, GREATEST(0.001e0, d.p_mono + (u.p_mono - d.p_mono) * GREATEST(0e0, frac * 40 - x.jd))) AS p
 FROM (SELECT *, CAST(LEAST(40, GREATEST(0, CEIL(frac * 40 - 1e-9))) AS INT) AS ju, CAST(GREATEST(0, FLOOR(frac * 40 + 1e-9)) AS INT) AS jd FROM
  (SELECT event_id, CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS INT) % 51 - 25 AS margin, (event_id % 1000) / 1000e0 AS frac FROM events) e) x
 JOIN (SELECT margin AS um, j AS uj, p_mono FROM surf) u ON u.um = x.margin AND u.uj = x.ju JOIN (SELECT margin AS dm, j AS dj, p_mono FROM surf) d ON d.dm = x.margin AND d.dj = x.jd""", **SURFACE))
def stream_win_probability(t):
    k = F.from_json("props", "k double").getField("k").cast("int")
    live = S.live_features(_events(t).select("event_id", "props"), k % 51 - 25, (F.col("event_id") % 1000) / 1000.0)
    return S.run_append(S.stream_wp(live.drop("props"), stored(_surface(t), "surface"), (LO, HI)), scratch_path(t.spark, "wp"))


@query("stream_latest_status", "user_id:b status:s event_id:b", """
 SELECT user_id, status, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'final' THEN 3 WHEN 'live' THEN 2 WHEN 'postponed' THEN 1 ELSE 0 END DESC, ts DESC, event_id) AS r FROM
 (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'final' WHEN 'click' THEN 'live' WHEN 'error' THEN 'postponed' ELSE 'scheduled' END AS status FROM events) x) y WHERE r = 1""")
def stream_latest_status(t):
    kind = F.col("event_type")
    rows = _timed(t).select("user_id", "ts", "event_id", F.when(kind == "purchase", "final").when(kind == "click", "live").when(kind == "error", "postponed").otherwise("scheduled").alias("status"))
    return S.run_latest(rows, "latest", "user_id", "ts", "status", ["event_id"])


@query("stream_play_windows", "user_id:b window_start:ts n:b total:d", """
 SELECT user_id, DATE_TRUNC('hour', ts) AS window_start, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY 1, 2""")
def stream_play_windows(t):
    rows = _timed(t).select("user_id", "ts", "value")
    return S.run_update(S.stream_windows(rows, "user_id", "ts", "1 hour"), "windows", ["user_id", "window_start"])


@query("stream_sliding_windows", "user_id:b window_start:ts n:b total:d", """
 SELECT user_id, w AS window_start, COUNT(*) AS n, SUM(value) AS total FROM (SELECT user_id, value, TIME_BUCKET(INTERVAL 30 MINUTE, ts) AS w FROM events UNION ALL
  SELECT user_id, value, TIME_BUCKET(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events) x GROUP BY 1, 2""")
def stream_sliding_windows(t):
    rows = _timed(t).select("user_id", "ts", "value")
    return S.run_update(S.stream_windows(rows, "user_id", "ts", "1 hour", "30 minutes"), "sliding", ["user_id", "window_start"])


@query("stream_bursts", "user_id:b burst_start:ts burst_end:ts n:b", """
 SELECT user_id, MIN(ts) AS burst_start, MAX(ts) + INTERVAL 6 HOUR AS burst_end, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM
  (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events) x) y GROUP BY user_id, b
 HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_bursts(t):
    return S.run_append(S.stream_bursts(_timed(t).select("user_id", "ts"), "user_id", "ts", "6 hours"), scratch_path(t.spark, "bursts"))


@query("stream_ratings", "league:s game_id:b home:b away:b home_elo:d away_elo:d prob:d late:b")
def stream_ratings(t):
    games = t.games().filter("home_win is not null").select("league", "season", "game_date", "game_id", "home", "away", "margin")
    rated = S.run_update(S.stream_elo(_shuffled_files(t, games, "finals"), R.CARRY, ANY_DAY), "ratings", ["league", "game_id"], late="late")
    return rated.withColumn("late", F.col("late").cast("int"))


FORM = dict(
    given="""SELECT *, LEAST(2, (season - 1992) // 2) + CASE WHEN game_id % 7 = 0 THEN 1 ELSE 0 END AS d FROM elog WHERE win IS NOT NULL""",
    closed="""SELECT a.d, MAX(b.game_date) - 400 AS until FROM (SELECT DISTINCT d FROM given) a JOIN given b ON b.d < a.d GROUP BY a.d""",
    held="""SELECT entity, game_id, game_date, win, COALESCE(game_date <= until, FALSE) AS late FROM given LEFT JOIN closed ON closed.d = given.d""")


@query("stream_form", "entity:b game_id:b form:d played:b late:b", over("elog", """
 SELECT entity, game_id, CASE WHEN NOT late THEN AVG(CAST(win AS DOUBLE)) OVER w END AS form, CASE WHEN NOT late THEN ROW_NUMBER() OVER (PARTITION BY entity, late ORDER BY game_date, game_id) - 1 END AS played, late FROM held
 WINDOW w AS (PARTITION BY entity, late ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""", **FORM))
def stream_form(t):
    log = t.log().filter("win is not null").select("entity", "game_date", "game_id", "win")
    # Two seasons and the last three come at a time, a seventh of all contests with the next ones; some of these are late.
    part = F.least(F.lit(2), F.floor((F.year("game_date") - 1992) / 2)).cast("int") + (F.col("game_id") % 7 == 0).cast("int")
    given = stored(log.withColumn("part", part), "given")
    feed, out = scratch_path(t.spark, "log"), scratch_path(t.spark, "form")
    for k in range(4):
        given.where(F.col("part") == k).drop("part").write.mode("append").parquet(feed)
        form = S.run_update(S.stream_form(S.file_stream(t.spark, feed, log.schema), 10), "form", ["entity", "game_id"], out, late="late")
    return form.withColumn("late", F.col("late").cast("int"))


@query("stream_ingest", "game_id:b margin:d delivery:b", over("games", "SELECT game_id, margin + CASE WHEN game_id % 5 = 0 THEN 1 ELSE 0 END AS margin, CASE WHEN game_id % 5 = 0 THEN 2 ELSE 1 END AS delivery FROM games"))
def stream_ingest(t):
    feed, land = scratch_path(t.spark, "deliveries"), scratch_path(t.spark, "landed")
    first = t.games().select("game_id", "margin", F.lit(1).alias("delivery"))
    again = first.filter("game_id % 5 = 0").select("game_id", (F.col("margin") + 1).alias("margin"), F.lit(2).alias("delivery"))
    for delivery in (first, again):
        delivery.write.mode("append").parquet(feed)
        for _ in range(2):  # the second run finds nothing new
            landed = S.ingest_increment(S.file_stream(t.spark, feed, first.schema), land, "game_id", land + "-progress", "delivery")
    return landed
