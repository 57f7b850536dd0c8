"""Structured Streaming over the live feed.

Results leave a query through files in the shared folder.  Updates carry the epoch they were
written in, so a repeated batch replaces its own output and the newest value per key is kept
when the output is read.
"""

from array import array
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from boutline.operators.ratings import EloParams, Ratings
from boutline.operators.states import surface_score
from boutline.session import scratch_path
from boutline.streaming.ledger import Ledger


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream, a limited number per batch, oldest first."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(path))


@contextmanager
def state_partitions(spark: SparkSession):
    """Size a new query's state by the cluster's parallelism: it is fixed at the first start and never coalesced.

    The state lies in RocksDB, which lists, maps and timers need and which keeps it out of the executor's heap.
    """
    wanted = {"spark.sql.shuffle.partitions": spark.sparkContext.defaultParallelism,
              "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_append(stream: DataFrame, path: str) -> DataFrame:
    """Drain an append-mode query into files and read them; a later run on the same path goes on from there."""
    spark = stream.sparkSession
    with state_partitions(spark):
        query = (stream.writeStream.format("parquet").option("checkpointLocation", path + "-progress")
                 .outputMode("append").trigger(availableNow=True).start(path))
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, label: str, keys: Sequence[str], path: str | None = None, late: str | None = None) -> DataFrame:
    """Drain an update-mode query; the newest epoch of each key counts. A later run on the same path goes on from there.

    Rows flagged in column ``late`` are the side output: they count for a key that has no other row.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with state_partitions(spark):
        query = (stream.writeStream.option("checkpointLocation", path + "-progress").foreachBatch(write)
                 .outputMode("update").trigger(availableNow=True).start())
        query.awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct((~F.col(late)).cast("int") if late else F.lit(1), F.col("epoch"))).alias("v"))
    return newest.select(*keys, "v.*")


def stream_wp(states: DataFrame, surface: DataFrame, margins: tuple[int, int]) -> DataFrame:
    """Live states to win probability: a lookup in the static surface, within the serving bounds."""
    scored = surface_score(states, surface, margins, linear=True)
    return scored.withColumn("p", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("p"))))


def progress(status: str) -> Column:
    # Progress order of the shared statuses.
    return F.when(F.col(status) == "final", 3).when(F.col(status) == "live", 2).when(F.col(status) == "postponed", 1).otherwise(0)


def run_latest(rows: DataFrame, label: str, key: str, ts: str, status: str, values: Sequence[str]) -> DataFrame:
    """Most-progressed row per contest, whatever the batches and their order.

    The maximum by (progress, time, values) is the same in any order and for repeated rows, so no state has to be kept or to
    expire: a batch adds its own maxima to a ledger, whose compaction bounds what a reader goes through. The least values win
    a tie in time.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows = rows.select(key, status, ts, *values)

    def best(df: DataFrame) -> DataFrame:
        rank = F.struct(progress(status), F.col(ts), *[-F.col(v) for v in values])
        return df.groupBy(key).agg(F.max_by(F.struct(status, ts, *values), rank).alias("r")).select(key, "r.*")

    ledger = Ledger(spark, path, best)
    query = (rows.writeStream.option("checkpointLocation", path + "-progress").foreachBatch(ledger.append)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return ledger.read(rows.schema)


def stream_windows(rows: DataFrame, key: str, ts: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per contest and time window."""
    return (rows.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(key, F.col("w.start").alias("window_start"), "n", "total"))


def stream_bursts(rows: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows of plays; a burst is emitted when the watermark has passed it."""
    return (rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n"))


EPOCH = date(1970, 1, 1)
ELO_OUT = ("league string, game_id long, game_date date, home long, away long, home_elo double, away_elo double, prob double, "
           "late boolean")
ELO_COLUMNS = [c.split()[0] for c in ELO_OUT.split(", ")]
#: Rows that a task collects before it gives them out.
OUT_ROWS = 20_000


class EloState(StatefulProcessor):
    """One league: the ratings up to its closed day, and a map of its open days. Of the open days a task holds the changed ones and one more."""

    def __init__(self, params: EloParams, late_days: int):
        self.params, self.late_days = params, late_days

    def init(self, handle) -> None:
        self.base = handle.getValueState("base", "entities array<long>, ratings array<double>, seasons_of array<int>, games array<long>, "
                                                 "wins array<double>, margins array<double>, seen array<int>, closed int")
        self.open = handle.getMapState("open", "season int, day int", "game_id array<long>, home array<long>, away array<long>, margin array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *old, closed = self.base.get() if self.base.exists() else ([],) * 7 + (None,)
        days, out = {}, []
        for batch in rows:
            for season, day, *row in zip(*(batch[c].tolist() for c in ("season", "game_date", "game_id", "home", "away", "margin"))):
                if closed is not None and (day - EPOCH).days <= closed:
                    out.append((key[0], row[0], day, row[1], row[2], None, None, None, True))
                else:
                    own = days.setdefault((int(season), (day - EPOCH).days), (array("q"), array("q"), array("q"), array("d")))
                    for column, value in zip(own, row):
                        column.append(value)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=ELO_COLUMNS)
                out = []
        if not days:
            yield pd.DataFrame(out, columns=ELO_COLUMNS)
            return
        known = {tuple(k) for k in self.open.keys()}
        changed = min(days)
        for at in days:
            # A repeated contest counts once, as it came first.
            first = {}
            for row in [*(zip(*self.open.getValue(at)) if at in known else ()), *zip(*days[at])]:
                first.setdefault(row[0], row)
            days[at] = None
            self.open.updateValue(at, tuple(map(list, zip(*(first[g] for g in sorted(first))))))
        places = sorted(known | set(days))
        until = max(day for _, day in places) - self.late_days
        until = until if closed is None else max(until, closed)
        entities, ratings, seasons_of, games, wins, margins, seen = old
        now = Ratings(self.params, [*zip(entities, ratings, seasons_of, games, wins, margins, [False] * len(entities)),
                                    *((0, 0.0, s, 0, 0.0, 0.0, True) for s in seen)])
        over = [at for at in places if at[1] <= until]
        for at in over + [at for at in places if at[1] > until]:
            season, day = at
            for game, home, away, margin in zip(*self.open.getValue(at)):
                h, a, p, *_ = now.play(season, home, away, margin, False)
                if at >= changed:
                    out.append((key[0], game, EPOCH + timedelta(days=day), home, away, h, a, p, False))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=ELO_COLUMNS)
                out = []
            if over and at == over[-1]:
                old = self._columns(now)
        for at in over:
            self.open.removeKey(at)
        self.base.update((*old, until))
        yield pd.DataFrame(out, columns=ELO_COLUMNS)

    @staticmethod
    def _columns(now: Ratings) -> list[list]:
        """The ratings of this moment, as lists that later contests do not change."""
        columns = [list(c) for c in zip(*((e, *v) for e, v in now.table.items()))]
        return [*columns, list(now.seasons)]

    def close(self) -> None:
        pass


def stream_elo(finals: DataFrame, params: EloParams, late_days: int = 400) -> DataFrame:
    """Ratings per league as finals arrive, each contest with its pregame values.

    The state holds the ratings up to its closed day and the contests after it, by day. Whenever contests arrive, those after the closed
    day are rated again in order, a day at a time, and given out again from the first changed day on, so the newest output per contest does
    not depend on how finals are batched. A final of a closed day, more than ``late_days`` behind the newest one of its league, is given out
    flagged ``late`` and rates nothing. A repeated final counts once.
    """
    return finals.groupBy("league").transformWithStateInPandas(EloState(params, late_days), ELO_OUT, "Update", "None")


DAY_MS = 86_400_000
FORM_OUT = "entity long, game_id long, form double, played long, late boolean"
FORM_COLUMNS = [c.split()[0] for c in FORM_OUT.split(", ")]


class FormState(StatefulProcessor):
    """One entity: its number of results, the last n of closed days and the rows of its open days, and a timer on the first of these.

    All of it is one value, read once and written once whenever the entity has rows or a day to close: a call for each open day
    takes longer than the fold.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "recent array<double>, played long, day array<int>, game_id array<long>, win array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        recent, played, days = self._read()
        out, changed = [], set()
        for batch in rows:
            for date_, game, win in zip(batch["game_date"].tolist(), batch["game_id"].tolist(), batch["win"].tolist()):
                day = (date_ - EPOCH).days
                if day * DAY_MS <= closed:
                    out.append((key[0], game, None, None, True))
                else:
                    days.setdefault(day, {})[game] = float(win)
                    changed.add(day)
        if changed:
            self._write(recent, played, days)
            if min(days) in changed:
                self.handle.registerTimer(min(days) * DAY_MS)
        for day in sorted(days) if changed else ():
            for game, win in sorted(days[day].items()):
                if day >= min(changed):
                    out.append((key[0], game, sum(recent) / len(recent) if recent else None, played, False))
                recent, played = (recent + [win])[-self.n:], played + 1
        yield pd.DataFrame(out, columns=FORM_COLUMNS).astype({"played": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        recent, played, days = self._read()
        over = [day for day in sorted(days) if day * DAY_MS <= closed]
        for day in over:
            wins = [win for _, win in sorted(days.pop(day).items())]
            recent, played = (recent + wins)[-self.n:], played + len(wins)
        if days:
            self.handle.registerTimer(min(days) * DAY_MS)
        if over:
            self._write(recent, played, days)
        return iter(())

    def _read(self) -> tuple[list[float], int, dict[int, dict[int, float]]]:
        if not self.held.exists():
            return [], 0, {}
        recent, played, *rows = self.held.get()
        days: dict[int, dict[int, float]] = {}
        for day, game, win in zip(*rows):
            days.setdefault(day, {})[game] = win
        return list(recent), played, days

    def _write(self, recent: list[float], played: int, days: dict[int, dict[int, float]]) -> None:
        rows = [(day, game, win) for day, games in days.items() for game, win in games.items()]
        self.held.update((recent, played, *(list(c) for c in (zip(*rows) if rows else ((), (), ())))))

    def close(self) -> None:
        pass


def stream_form(log: DataFrame, n: int, late_days: int = 400) -> DataFrame:
    """Mean of the last n results before each contest, per entity; the newest output per contest counts.

    A day closes when the newest day of all earlier batches is ``late_days`` ahead of it. The state of an entity holds the last
    n results of closed days and the rows of open ones; rows of an open day are given out again from the first changed day on.
    So the answer does not depend on how open days are cut into batches. What comes for a closed day is given out flagged ``late``
    and changes nothing. A repeated row counts once.
    """
    # The watermark's column is left out below it: rows behind it are to be flagged, and Spark would drop them.
    timed = log.withColumn("at", F.timestamp_seconds(F.unix_date("game_date").cast("long") * 86_400)).withWatermark("at", f"{late_days} days")
    rows = timed.select("entity", "game_date", "game_id", "win")
    return rows.groupBy("entity").transformWithStateInPandas(FormState(n), FORM_OUT, "Update", "EventTime")


def newest_deliveries(key: str, version: str):
    """All rows of each contest's newest delivery, repeated ones once."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(key).agg(F.max(version).alias(version))
        return rows.join(newest, [key, version]).distinct().select(*rows.columns)

    return merge


def ingest_increment(stream: DataFrame, path: str, key: str, progress: str, version: str | None = None, every: int = 8) -> DataFrame:
    """Land a stream so that a contest's newest delivery replaces the older ones; the table is returned.

    Rows name their delivery in column ``version``; one delivery may then come in any number of batches. Without it a batch is
    a delivery. A batch appends what is newest in itself and touches nothing that lies there; a repeated batch or run adds nothing.
    """
    name, schema = version or "__epoch", stream.schema if version else stream.withColumn("__epoch", F.lit(0).cast("long")).schema
    ledger = Ledger(stream.sparkSession, path, newest_deliveries(key, name), every)

    def write(batch: DataFrame, epoch: int) -> None:
        ledger.append(batch if version else batch.withColumn(name, F.lit(epoch).cast("long")), epoch)

    (stream.writeStream.option("checkpointLocation", progress).foreachBatch(write)
     .trigger(availableNow=True).start().awaitTermination())
    return ledger.read(schema).drop("__epoch")


def live_features(events: DataFrame, margin: Column, frac: Column) -> DataFrame:
    return events.select("*", margin.alias("margin"), frac.alias("frac"))
