"""History features: values each row may see from rows before it.

One key may own a large share of all rows, so no step here puts a whole key
into one task.  Cumulative values are pre-aggregated per (key, day), turned into
running totals over at most one row per calendar day, and completed by the rows
of the same day.  Trailing windows run inside fixed-length stretches of a key's
sequence, each stretch carrying the few neighbouring rows its windows reach.
"""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

STRETCH = 4096


@dataclass(frozen=True)
class Running:
    """A decomposable running aggregate: kind is sum, count, max or min."""

    kind: str
    value: Column

    def over_rows(self) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.kind](self.value)

    def over_partials(self, col: str) -> Column:
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.kind](F.col(col))

    def combine(self, a: Column, b: Column) -> Column:
        if self.kind == "max":
            return F.greatest(a, b)
        if self.kind == "min":
            return F.least(a, b)
        both = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if self.kind == "count":
            return both.cast("long")
        return F.when(a.isNotNull() | b.isNotNull(), both)


def run_sum(value) -> Running:
    return Running("sum", _col(value))


def run_count(value) -> Running:
    return Running("count", _col(value))


def run_max(value) -> Running:
    return Running("max", _col(value))


def run_min(value) -> Running:
    return Running("min", _col(value))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over ``parts`` tasks; without ``parts`` that is left to Spark."""
    return df.repartition(parts, *keys) if parts else df


def _day_totals(log: DataFrame, keys: Sequence[str], day: str, running: Mapping[str, Running],
                totals: Mapping[str, Running], parts: int | None = None) -> DataFrame:
    """Per (key, day): running values over earlier days, and totals over the whole key."""
    own = [r.over_rows().alias(f"__d_{n}") for n, r in running.items()]
    own += [r.over_rows().alias(f"__t_{n}") for n, r in totals.items()]
    daily = dealt(log.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("__rows"), *own), parts, *keys)
    w = Window.partitionBy(*keys).orderBy(day)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return daily.select(
        *keys, day,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        *[r.over_partials(f"__d_{n}").over(earlier).alias(f"__d_{n}") for n, r in running.items()],
        *[r.over_partials(f"__t_{n}").over(whole).alias(n) for n, r in totals.items()],
    )


def with_running(log: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str],
                 running: Mapping[str, Running] | None = None,
                 totals: Mapping[str, Running] | None = None,
                 strict_day: bool = False, parts: int | None = None) -> DataFrame:
    """Add ``seq`` (1-based position per key) and running values over earlier rows.

    Rows are ordered by (day, tie).  With ``strict_day`` only earlier days count.
    ``totals`` are aggregates over the whole key, for back-labelling. ``parts`` is the number of tasks, for large logs.
    """
    running, totals = running or {}, totals or {}
    log = dealt(log, parts, *keys, day)
    out = log.join(_day_totals(log, keys, day, running, totals, parts), [*keys, day])
    in_day = Window.partitionBy(*keys, day).orderBy(*tie)
    earlier = in_day.rowsBetween(Window.unboundedPreceding, -1)
    cols = {"seq": F.col("__before") + F.row_number().over(in_day)}
    for name, r in running.items():
        if strict_day:
            value = F.col(f"__d_{name}")
            cols[name] = F.coalesce(value, F.lit(0)).cast("long") if r.kind == "count" else value
        else:
            cols[name] = r.combine(F.col(f"__d_{name}"), r.over_rows().over(earlier))
    return out.withColumns(cols).drop("__before", *[f"__d_{n}" for n in running])


WindowColumn = Callable[[object], Column]


def stretched(log: DataFrame, back: int, ahead: int, stretch: int = STRETCH) -> tuple[DataFrame, Column]:
    """Rows with their ``__stretch`` of the sequence, and the condition under which a row stands in its own one; needs ``seq``.

    The last ``back`` rows of a stretch are copied to the next one, and the first ``ahead`` rows to the previous one.
    """
    stretch = max(stretch, back, ahead)
    at = (F.col("seq") - 1) % stretch
    home = F.floor((F.col("seq") - 1) / stretch)
    copies = [home]
    if back:
        copies.append(F.when(at >= stretch - back, home + 1))
    if ahead:
        copies.append(F.when((at < ahead) & (home > 0), home - 1))
    return log.withColumn("__stretch", F.explode(F.array_compact(F.array(*copies)))), F.col("__stretch") == home


def with_trailing(log: DataFrame, keys: Sequence[str], features: Mapping[str, tuple[int, WindowColumn]],
                  stretch: int = STRETCH, parts: int | None = None) -> DataFrame:
    """Add features over the n rows before each row, or the n rows after it when n is negative; needs ``seq``.

    ``features`` maps a name to (n, fn); fn receives the window.  Rows near the end (start) of a stretch
    are copied to the next (previous) one, so a window never spans more than ``stretch`` + 2n rows. ``parts`` is the number of
    tasks, for large logs.
    """
    back = max([n for n, _ in features.values() if n > 0], default=0)
    ahead = max([-n for n, _ in features.values() if n < 0], default=0)
    rows, own = stretched(log, back, ahead, stretch)
    rows = dealt(rows, parts, *keys, "__stretch")
    w = Window.partitionBy(*keys, "__stretch").orderBy("seq")
    cols = {name: fn(w.rowsBetween(-n, -1) if n > 0 else w.rowsBetween(1, -n)) for name, (n, fn) in features.items()}
    return rows.withColumns(cols).filter(own).drop("__stretch")


def first_of_day(log: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Give every row of a (key, day) the values its first row saw: the strictly-earlier-day view."""
    in_day = Window.partitionBy(*keys, day).orderBy(*tie)
    return log.withColumns({c: F.first(c).over(in_day) for c in columns})


def mean_of(value, min_rows: int = 1) -> WindowColumn:
    def build(w):
        v = _col(value)
        if min_rows <= 1:
            return F.avg(v).over(w)
        return F.when(F.count(v).over(w) >= min_rows, F.avg(v).over(w))
    return build


def signed_run(last_hit: Column, last_miss: Column) -> Column:
    """Signed length of the current run, from the last positions of a hit and of a miss."""
    hit, miss = F.coalesce(last_hit, F.lit(0)), F.coalesce(last_miss, F.lit(0))
    return F.when(hit > miss, hit - miss).otherwise(-(miss - hit))


def asof_running(requests: DataFrame, log: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str],
                 running: Mapping[str, str]) -> DataFrame:
    """Running sums of ``log`` as of each request's (day, tie), earlier log rows only.

    ``running`` maps an output name to a numeric log column.  Log rows with the same (day, tie) as the
    request are not counted.  The days asked for stand among a key's log days, one row per (key, day),
    and take the sums of the days before; requests look theirs up by equality.  Only requests on a log
    day of their key look at single rows.
    """
    names = list(running)
    facts = log.select(*keys, day, *tie, *[F.col(c).cast("double").alias(n) for n, c in running.items()])
    daily = facts.groupBy(*keys, day).agg(F.lit(True).alias("__busy"), *[F.sum(n).alias(n) for n in names])
    days = (daily.unionByName(requests.select(*keys, day).distinct(), allowMissingColumns=True)
            .groupBy(*keys, day).agg(F.max("__busy").alias("__busy"), *[F.sum(n).alias(n) for n in names]))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*keys, day, "__busy", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"__b_{n}") for n in names])
    asked = requests.join(before, [*keys, day])
    quiet = asked.filter("__busy is null").select(*requests.columns, *[F.col(f"__b_{n}").alias(n) for n in names])
    busy = asked.filter("__busy").select(*keys, day, *tie, F.struct(*requests.columns, *[f"__b_{n}" for n in names]).alias("__req"))
    both = busy.unionByName(facts, allowMissingColumns=True)
    ranked = both.withColumn("__pos", F.dense_rank().over(Window.partitionBy(*keys, day).orderBy(*tie)))
    in_day = Window.partitionBy(*keys, day).orderBy("__pos").rangeBetween(Window.unboundedPreceding, -1)
    summed = (ranked.withColumns({n: F.coalesce(F.sum(n).over(in_day), F.lit(0.0)) for n in names})
              .filter("__req is not null"))
    return quiet.unionByName(summed.select(
        *[F.col(f"__req.{c}").alias(c) for c in requests.columns],
        *[(F.col(n) + F.col(f"__req.__b_{n}")).alias(n) for n in names]))


def latest_before(left: DataFrame, history: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """As-of join: the newest ``history`` row strictly before the left row's day.

    History is reduced to one row per (key, day) first, so the running search holds at most
    one row per calendar day and key.
    """
    packed = F.struct(*columns)
    order = F.struct(day, *tie)
    newest = history.groupBy(*keys, day).agg(F.max_by(packed, order).alias("__v"))
    days = (newest.unionByName(left.select(*keys, day).distinct(), allowMissingColumns=True)
            .groupBy(*keys, day).agg(F.first("__v", ignorenulls=True).alias("__v")))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    seen = days.select(*keys, day, F.last("__v", ignorenulls=True).over(earlier).alias("__v"))
    return left.join(seen, [*keys, day], "left").select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in columns])
