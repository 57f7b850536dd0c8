"""Contest views over the star-schema tables: games, entity log, members, states, odds, predictions.

An order with at least two suppliers is a contest between its lowest and highest supplier;
quantities are scores, event streams are in-contest states.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from boutline.functions.odds import devig, implied_prob
from boutline.operators.timeline import run_count, run_sum, with_running

#: Bytes of the lines' file for each part of a layout by order.
PART_BYTES = 4 << 20
ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles"]


class Tables:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Quantity and line count per (order, supplier)."""
        return (self.read("lineitem").groupBy("l_orderkey", "l_suppkey")
                .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n_lines")))

    def games(self) -> DataFrame:
        """One row per contest; home_win is NULL on a tie."""
        side = F.struct("l_suppkey", "q")
        pairs = (self.lines().groupBy("l_orderkey")
                 .agg(F.min(side).alias("lo"), F.max(side).alias("hi"))
                 .filter("lo.l_suppkey <> hi.l_suppkey"))
        even = F.col("l_orderkey") % 2 == 0
        pairs = pairs.select(F.col("l_orderkey").alias("game_id"),
                             F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("h"),
                             F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("a"))
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"),
            F.col("o_orderpriority").alias("league"))
        margin = F.col("h.q") - F.col("a.q")
        return pairs.join(orders, "game_id").select(
            "game_id", F.year("game_date").alias("season"), "game_date", "league",
            F.col("h.l_suppkey").alias("home"), F.col("a.l_suppkey").alias("away"),
            F.col("h.q").alias("home_score"), F.col("a.q").alias("away_score"), margin.alias("margin"),
            F.when(margin > 0, 1).when(margin < 0, 0).alias("home_win"))

    def log(self) -> DataFrame:
        return entity_log(self.games())

    def dim(self) -> DataFrame:
        """Entities with conference, division, coordinates and home time zone."""
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        zone = reduce(lambda acc, i: acc.when(F.col("n_nationkey") % 4 == i, ZONES[i]),
                      range(1, 4), F.when(F.col("n_nationkey") % 4 == 0, ZONES[0]))
        return (self.read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"),
                        F.col("r_name").alias("conference"), F.col("n_name").alias("division"),
                        (F.col("n_nationkey") + 25).cast("double").alias("lat"),
                        (F.col("n_nationkey") * 2 - 120).cast("double").alias("lon"), zone.alias("tz")))

    def by_order(self, columns: list[str]) -> DataFrame:
        """Lines laid out by order, so that groups below an order are formed where its lines are.

        There are as many parts as the file has ``PART_BYTES``: what one task holds does not grow with the table.
        """
        rows, parts = self.read("lineitem").select("l_orderkey", *columns), self.parts("lineitem")
        return rows.repartition(parts, "l_orderkey") if parts else rows.repartition("l_orderkey")

    def parts(self, name: str) -> int | None:
        """How many ``PART_BYTES`` a file has, if that is more than the default parallelism."""
        size = self.read(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        parts = -(-size // PART_BYTES)
        return parts if parts > self.spark.sparkContext.defaultParallelism else None

    def members(self) -> DataFrame:
        """Member-contest log: one row per (game, entity, member)."""
        rows = (self.by_order(["l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount"]).groupBy("l_orderkey", "l_suppkey", "l_partkey")
                .agg(F.sum("l_quantity").alias("points"), F.sum("l_tax").alias("tax"),
                     F.sum("l_discount").alias("discount")))
        orders = self.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("game_date"))
        return rows.join(orders, rows.l_orderkey == orders.o_orderkey).select(
            F.col("l_orderkey").alias("game_id"), F.year("game_date").alias("season"), "game_date",
            F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("member"), "points",
            F.round(F.col("tax") * 1000 + 5).alias("minutes"), F.round(F.col("discount") * 100).alias("shots"))

    def odds(self) -> DataFrame:
        """Moneylines and a spread per contest, from the order key."""
        k = F.col("game_id") % 200
        return self.games().select(
            "game_id", "season", "game_date", "home", "away", "margin", "home_win",
            F.when(k < 100, -(k * 3 + 110)).otherwise(k * 3 - 200).cast("double").alias("home_ml"),
            F.when(k < 100, k * 3 + 100).otherwise(-(k * 3 - 190)).cast("double").alias("away_ml"),
            ((F.lit(100) - k) / 10.0).cast("double").alias("spread_line"))

    def states(self) -> DataFrame:
        """In-contest states from the event log: running score, fraction left, period, final label."""
        kind = F.col("event_type")
        home = F.when(kind == "click", 1).when(kind == "purchase", 3).otherwise(0)
        away = F.when(kind == "view", 1).when(kind == "error", 3).otherwise(0)
        ev = self.read("events").select(F.col("user_id").alias("game_id"), "ts", "event_id", "event_type", "value",
                                        F.to_date("ts").alias("day"), home.alias("dh"), away.alias("da"))
        rows = with_running(ev, ["game_id"], "day", ["ts", "event_id"],
                            running={"h0": run_sum("dh"), "a0": run_sum("da")},
                            totals={"n": run_count("event_id"), "final_margin": run_sum(F.col("dh") - F.col("da"))})
        hs = F.coalesce("h0", F.lit(0)) + F.col("dh")
        sc = F.coalesce("a0", F.lit(0)) + F.col("da")
        return rows.select(
            "game_id", "seq", "ts", "day", "event_id", "event_type", "value", "n",
            (1 - F.col("seq") / F.col("n")).alias("frac"),
            F.ceil(F.col("seq") * 4 / F.col("n")).cast("int").alias("period"),
            hs.alias("home_score"), sc.alias("away_score"), (hs - sc).alias("margin"), "final_margin",
            F.when(F.col("final_margin") > 0, 1).when(F.col("final_margin") < 0, 0).alias("home_won"))

    def preds_wide(self) -> DataFrame:
        """Three pregame home-win probabilities per decided contest."""
        g = self.odds()
        log = entity_log(g).select("entity", "season", "game_date", "game_id", "win", "is_home")
        day = (log.groupBy("entity", "season", "game_date")
               .agg(F.sum("win").cast("double").alias("w"), F.count("win").alias("g")))
        earlier = Window.partitionBy("entity", "season").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
        pct = F.try_divide(F.sum("w").over(earlier), F.sum("g").over(earlier))
        form = day.select("entity", "game_date", F.coalesce(pct, F.lit(0.5)).alias("form"))
        prior = (day.groupBy("entity", "season").agg(F.try_divide(F.sum("w"), F.sum("g")).alias("prior"))
                 .select("entity", (F.col("season") + 1).alias("season"), "prior"))
        out = g.filter("home_win is not null")
        for side in ("home", "away"):
            out = (out.join(form.withColumnsRenamed({"entity": side, "form": f"{side}_form"}), [side, "game_date"])
                   .join(prior.withColumnsRenamed({"entity": side, "prior": f"{side}_prior"}), [side, "season"], "left"))
        half = F.lit(0.5)
        return out.select(
            "season", "game_id", "game_date", "home", "away", "margin", "home_win", "home_ml", "away_ml", "spread_line",
            devig(implied_prob("home_ml"), implied_prob("away_ml")).alias("p_market"),
            _bounded(half + 0.4 * (F.col("home_form") - F.col("away_form"))).alias("p_form"),
            _bounded(half + 0.3 * (F.coalesce("home_prior", half) - F.coalesce("away_prior", half))).alias("p_prior"))

    def preds(self) -> DataFrame:
        """Long predictions: (model_id, season, game_id, game_date, home, away, y, p)."""
        models = ["form", "market", "prior"]
        return self.preds_wide().select(
            "season", "game_id", "game_date", "home", "away", "margin", F.col("home_win").alias("y"),
            F.inline(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"p_{m}").alias("p")) for m in models])))


def _bounded(c: Column) -> Column:
    return F.greatest(F.lit(0.02), F.least(F.lit(0.98), c))


def entity_log(games: DataFrame) -> DataFrame:
    """Two rows per contest, one per side, from a single scan of the games."""
    shared = [c for c in games.columns if c not in
              {"home", "away", "home_score", "away_score", "margin", "home_win"}]
    has_score = "home_score" in games.columns

    def view(me: str, other: str, sign: int, flag: int) -> Column:
        won = F.col("home_win") if flag else 1 - F.col("home_win")
        cols = [F.col(me).alias("entity"), F.col(other).alias("opponent"), F.lit(flag).alias("is_home")]
        if has_score:
            cols += [F.col(f"{me}_score").alias("score"), F.col(f"{other}_score").alias("opp_score")]
        return F.struct(*cols, (sign * F.col("margin")).alias("diff"), won.alias("win"))

    return games.select(*shared, F.inline(F.array(view("home", "away", 1, 1), view("away", "home", -1, 0))))
