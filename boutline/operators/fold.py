"""Order-dependent folds in bounded pieces.

A fold whose next step needs the last step's result cannot be split by rows.  What can be bounded is
what one task holds: Spark sorts a group's rows, and the task reads them a batch at a time, so that it keeps the
group's state and one batch, never the group.  The time line of a group is also cut into stretches of whole days with a limited
number of rows, the stretches run one after another, and only the state passes between them.  Each
stretch is written, so a lost executor repeats one stretch.  Groups (leagues, parameter sets) run
in parallel.
"""

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby, islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from boutline.session import scratch_path, stored

MAX_ROWS = 2_000_000
#: Rows that a task turns into columns at once.
BATCH = 5_000


class Fold(Protocol):
    """One group's state; it is made from the state's rows, all of which it takes, one after the other."""

    def row(self, *values) -> Iterable[tuple]:
        """Take the next row; the rows out that are now settled."""

    def end(self) -> Iterable[tuple]:
        """The rows out that are left after the last row of a stretch."""

    def state(self) -> Iterable[tuple]:
        """The state's rows."""


def chunked_fold(rows: DataFrame, by: Sequence[str], day: str, order: Sequence[str], begin: Callable[[Iterator[tuple]], Fold], out: str, state: str,
                 max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Run a fold over each group's rows in the order of ``order``, nulls last; it gets a row's values without the group columns.

    ``out`` and ``state`` are DDL column lists without the group columns.  Returns both tables.  Rows without a group or day are left out.
    """
    by = list(by)
    spark = rows.sparkSession
    given = stored(rows.dropna(subset=[*by, day]), "fold")
    values = [c for c in given.columns if c not in by]
    keys_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*by).schema)
    out_schema, state_schema = (spark.createDataFrame([], ddl).schema for ddl in (out, state))
    flat = ", ".join([keys_ddl, "__kind string", *_prefixed(out_schema, "o_"), *_prefixed(state_schema, "s_")])
    kinds = to_arrow_schema(spark.createDataFrame([], flat).schema)
    no_out, no_state, n_by, n_values = (None,) * len(out_schema), (None,) * len(state_schema), len(by), len(values)

    per_day = given.groupBy(*by, day).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_day.select(*by, day, F.floor(F.coalesce(F.sum("__n").over(earlier), F.lit(0)) / max_rows).cast("int").alias("__chunk"))
    last = placed.agg(F.max("__chunk")).first()[0]
    if last is None:
        return spark.createDataFrame([], f"{keys_ddl}, {out}"), spark.createDataFrame([], f"{keys_ddl}, {state}")

    def made(rows):
        for key, group in groupby(rows, key=lambda r: r[:n_by]):
            first = []

            def before():
                for r in group:
                    if r[n_by]:
                        first.append(r)
                        return
                    yield r[n_by + 1 + n_values:]

            old = before()
            fold = begin(old)
            if next(old, None) is not None:
                raise ValueError("a fold is made from all rows of its state")
            for r in chain(first, group):
                yield from ((*key, "row", *x, *no_state) for x in fold.row(*r[n_by + 1:n_by + 1 + n_values]))
            yield from ((*key, "row", *x, *no_state) for x in fold.end())
            yield from ((*key, "state", *no_out, *x) for x in fold.state())

    def run(batches):
        # The state too comes and goes a batch at a time.
        out = made(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        while piece := list(islice(out, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*piece), kinds)], schema=kinds)

    if last:
        # Written once more, one folder per stretch, so each step reads only its own rows.
        path = scratch_path(spark, "stretches")
        given.join(placed, [*by, day]).write.partitionBy("__chunk").parquet(path)
        parts = spark.read.parquet(path)
    state_df, pieces = spark.createDataFrame([], f"{keys_ddl}, {state}"), []
    for chunk in range(last + 1):
        part = parts.filter(F.col("__chunk") == chunk) if last else given
        own = part.select(*by, F.lit(1).alias("__kind"), *values)
        old = state_df.select(*by, F.lit(0).alias("__kind"), *[F.col(c).alias(f"s_{c}") for c in state_schema.names])
        both = own.unionByName(old, allowMissingColumns=True).select(*by, "__kind", *values, *[f"s_{c}" for c in state_schema.names])
        ready = both.repartition(*by).sortWithinPartitions(*by, "__kind", *[F.asc_nulls_last(c) for c in order])
        done = stored(ready.mapInArrow(run, flat), "stretch")
        pieces.append(done.filter("__kind = 'row'").select(*by, *[F.col(f"o_{c}").alias(c) for c in out_schema.names]))
        state_df = done.filter("__kind = 'state'").select(*by, *[F.col(f"s_{c}").alias(c) for c in state_schema.names])
    result = pieces[0]
    for p in pieces[1:]:
        result = result.unionByName(p)
    return result, state_df


def _prefixed(schema, prefix: str) -> list[str]:
    return [f"{prefix}{f.name} {f.dataType.simpleString()}" for f in schema]
