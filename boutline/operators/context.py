"""Schedule strength, roster context, starters and pitcher priors."""

import heapq
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boutline.functions.odds import clamp
from boutline.operators.fold import MAX_ROWS, chunked_fold
from boutline.operators.history import DAY, TIE, ewm_of
from boutline.operators.timeline import STRETCH, mean_of, run_max, run_sum, stretched, with_running, with_trailing
from boutline.session import released, stored

#: Rows whose times and rates travel at once, and into how many turns they are dealt at most: disk is taken for one turn only.
TURN_ROWS, TURNS = 1 << 20, 8


def _prefix(group: np.ndarray, day: np.ndarray, game: np.ndarray, wins: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(wins, contests) of the asked groups before the asked (day, contest); contests are in order by group, day and contest."""
    of, on, before = asked
    place, wanted = (group << 33) + (day + (1 << 31)), (of << 33) + (on + (1 << 31))
    low, high = np.searchsorted(place, wanted), np.searchsorted(place, wanted, "right")
    # Contests of the same day come before the asked one if their number is lower.
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less = game[middle] < before[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    first, total = np.searchsorted(group, of), np.concatenate([[0.0], np.cumsum(wins)])
    return total[low] - total[first], low - first


def _rates_at(won: DataFrame, meetings: DataFrame) -> DataFrame:
    """``meetings`` with ``__rates`` instead of the times (``__days``, ``__games``): the opponent's win rate before each, null before its first contest.

    A task reads an opponent's contests of a season in order, and then, a batch at a time, the rows that ask for its rate. It keeps the
    contests of one opponent and season: a day, a number and a result each.
    """
    names = [c for c in meetings.columns if c not in ("__days", "__games")]
    schema = T.StructType([*[meetings.schema[c] for c in names], T.StructField("__rates", T.ArrayType(T.DoubleType()))])
    kinds = to_arrow_schema(schema)

    def run(batches):
        last, kept = None, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            season, other = (column[c].to_numpy(zero_copy_only=False) for c in ("season", "opponent"))
            new = np.ones(batch.num_rows, bool)
            new[1:] = (season[1:] != season[:-1]) | (other[1:] != other[:-1])
            new[0] = last != (season[0], other[0])
            group, last = np.cumsum(new), (season[-1], other[-1])
            asks = column["__asks"].to_numpy(zero_copy_only=False)
            fact = ~asks
            own = [column[DAY].cast(pa.int32()).to_numpy(zero_copy_only=False)[fact].astype(np.int64), column["game_id"].to_numpy(zero_copy_only=False)[fact],
                   column["win"].cast(pa.float64()).to_numpy(zero_copy_only=False)[fact]]
            facts = [np.concatenate(both) for both in zip(kept, own)]
            of = np.concatenate([np.zeros(len(kept[0]), np.int64), group[fact]])
            kept = [c[of == group[-1]] for c in facts]
            if not asks.any():
                continue
            days, games, *rows = (column[c].filter(pa.array(asks)) for c in ("__days", "__games", *names))
            size = days.value_lengths().to_numpy(zero_copy_only=False)
            wins, count = _prefix(of, *facts, (np.repeat(group[asks], size), days.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                               games.flatten().to_numpy(zero_copy_only=False)))
            rates = pa.array(wins / np.maximum(count, 1), mask=count == 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(ends, rates)], schema=kinds)

    facts = won.select("season", F.col("entity").alias("opponent"), DAY, "game_id", "win", F.lit(False).alias("__asks"))
    both = meetings.withColumn("__asks", F.lit(True)).unionByName(facts.dropna(subset=["season", "opponent", DAY, "game_id"]), allowMissingColumns=True)
    return (both.repartition("season", "opponent").sortWithinPartitions("season", "opponent", "__asks", DAY, "game_id")
            .mapInArrow(run, schema))


def schedule_strength(log: DataFrame, past: int = 20, ahead: int = 10) -> DataFrame:
    """Current win rate of the opponents already met and of those still to come, per contest.

    The opponents' rates are those of this contest's moment, not of the meeting.  A contest is among the last ``past`` of the
    entity's next contests and among the next ``ahead`` of its earlier ones.  So each contest takes the times of these to its
    opponent, in two arrays, and brings the opponent's rates back; no row stands for a single pair of contest and opponent. These arrays
    are most of what is shuffled, so large logs go in turns, by stretches of entities, each written before the next one begins.
    """
    keys = ["season", "entity"]
    won = stored(log.filter("win is not null").select("season", "entity", "opponent", DAY, "game_id", "win"), "won")
    placed = stored(with_running(won, keys, DAY, TIE, running={"w0": run_sum("win")}), "placed")
    # Rate of the opponent right after the last meeting, from the opponent's own row of that contest.
    after = placed.select("season", F.col("entity").alias("opponent"), "game_id",
                          ((F.coalesce("w0", F.lit(0)) + F.col("win")) / F.col("seq")).alias("opp_after"))
    met = stored(placed.join(after, ["season", "opponent", "game_id"]).drop("w0"), "met")
    released(placed)
    turns, parts = max(1, min(TURNS, -(-met.count() // TURN_ROWS))), None
    for turn in range(turns):
        part = stored(_met_rates(won, met, past, ahead, turn, turns), "strength")
        parts = part if parts is None else parts.union(part)
    released(won, met)
    # Rows that share the contest share its sums.
    names = ("past", "last3", "ahead")
    whole = Window.partitionBy(*keys, "game_id")
    rows = parts.withColumns({f"__{k}_{n}": F.sum(f"__{k}_{n}").over(whole) for n in names for k in ("s", "n")})
    rows = rows.withColumns({f"sos_{n}": F.try_divide(f"__s_{n}", f"__n_{n}") for n in names} | {"sos_sum": F.when(F.col("__n_past") > 0, F.col("__s_past"))})
    return rows.drop(*[f"__{k}_{n}" for n in names for k in ("s", "n")])


def _met_rates(won: DataFrame, met: DataFrame, past: int, ahead: int, turn: int, turns: int) -> DataFrame:
    """The rows of ``met`` whose stretch has its turn, with the sum and number of their opponents' rates (``__s_``, ``__n_``)."""
    keys = ["season", "entity"]
    rows, own = stretched(met, past, ahead)
    rows = rows.where(F.pmod(F.xxhash64(*keys, "__stretch"), F.lit(turns)) == turn)
    w = Window.partitionBy(*keys, "__stretch").orderBy("seq")
    time = F.struct(F.unix_date(DAY).alias("day"), F.col("game_id").alias("game"))
    rows = rows.withColumns({"__place": F.row_number().over(w), "last_opponent_pct": F.first("opp_after").over(w.rowsBetween(-1, -1)),
                             "__before": F.collect_list(time).over(w.rowsBetween(-ahead, -1)), "__after": F.collect_list(time).over(w.rowsBetween(1, past))})
    times = F.concat("__before", "__after")
    rows = rows.withColumns({"__soon": F.size("__before"), "__days": times["day"], "__games": times["game"]}).drop("__before", "__after", "opp_after")
    rows = _rates_at(won, rows)
    w = Window.partitionBy(*keys, "__stretch").orderBy("__place")
    # A contest k places back brings the rate at its k-th time after itself, one k places ahead that at its k-th time before.
    met = F.array(*[F.lag(F.get("__rates", F.col("__soon") + (k - 1)), k).over(w) for k in range(1, past + 1)])
    soon = F.array(*[F.lead(F.get("__rates", F.col("__soon") - k), k).over(w) for k in range(1, ahead + 1)])
    rows = rows.withColumns({"__met": met, "__next": soon}).filter(own)
    rates = {"past": F.array_compact("__met"), "last3": F.array_compact(F.slice("__met", 1, 3)), "ahead": F.array_compact("__next")}
    rows = rows.withColumns({f"__s_{n}": F.aggregate(a, F.lit(0.0), lambda x, y: x + y) for n, a in rates.items()} | {f"__n_{n}": F.size(a) for n, a in rates.items()})
    return rows.drop("__rates", "__met", "__next", "__soon", "__place", "__stretch")


#: Rates count as equal if they agree in these many places; a bucket holds 2^24 of the 10^9 + 1 such rates.
PLACES, BUCKET = 9, 24


def counts_below(day: np.ndarray, value: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """For every row, the sum of ``delta`` over rows of the same or an earlier day whose value is at most the row's.

    Values are ranked and read bit by bit: at each bit, a row that has it adds the running sum of the rows with the same higher bits that
    lack it. That is one stable sort and one running sum per bit, without a loop over rows.
    """
    if not len(day):
        return np.zeros(0, np.int64)
    rank = np.unique(value, return_inverse=True)[1]
    # Changes of a day stand before what is asked on that day; a row that asks has delta 0.
    at = np.lexsort((delta == 0, day))
    rank, change = rank[at], delta[at]
    total = np.zeros(len(day), np.int64)

    def running(group: np.ndarray, amount: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        upto = np.cumsum(amount[order])
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
        before = np.repeat(upto[first] - amount[order][first], np.diff(np.append(first, len(group))))
        out = np.empty(len(group), np.int64)
        out[order] = upto - before
        return out

    for bit in range(int(rank.max()).bit_length()):
        has = (rank >> bit) & 1
        total += np.where(has == 1, running(rank >> (bit + 1), np.where(has == 0, change, 0)), 0)
    total += running(rank, change)
    out = np.empty(len(day), np.int64)
    out[at] = total
    return out


def _asked(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., __day, __v, __at_most): counts for the rows that ask, each group in one task."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame["__at_most"] = counts_below(*(frame[c].to_numpy() for c in ("__day", "__v", "__delta")))
        return frame.loc[frame["__delta"] == 0, [*group, "__day", "__v", "__at_most"]]

    return rows.groupBy(*group).applyInPandas(task, f"{kinds}, __day int, __v long, __at_most long")


def day_percentiles(log: DataFrame, requests: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Where values stand among all entities' season win rates at the start of the day.

    Adds ``<name>`` = share (0..100) of entities whose rate is <= the request's value; null without a value or before any entity has a
    rate. Rates equal to nine places are equal, since sums taken in a different order differ in the last bits.

    A contest day changes an entity's rate from the next day on: one more at the new rate, one less at the old. Changes are added up per
    (season, day, rate). What lies in lower rate buckets is counted over changes per bucket, at most 60 a day whatever the number of
    entities; what lies in the value's own bucket over that bucket's changes, at most one per day and rate, and rates are fractions with the
    number of an entity's contests below them.
    """
    keys = ["season", "entity"]
    per_day = log.filter("win is not null").groupBy(*keys, DAY).agg(F.sum("win").alias("w"), F.count("win").alias("g"))
    w = Window.partitionBy(*keys).orderBy(DAY)
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def place(rate: Column) -> Column:
        return F.round(F.round(rate, PLACES) * 10.0 ** PLACES).cast("long")

    held = per_day.withColumn("v", place(F.sum("w").over(run) / F.sum("g").over(run))).withColumn("old", F.lag("v").over(w))
    one = F.array(F.struct(F.col("v").alias("__v"), F.lit(1).alias("d")), F.struct(F.col("old").alias("__v"), F.lit(-1).alias("d")))
    changes = held.select("season", (F.unix_date(F.col(DAY)) + 1).alias("__day"), F.inline(one)).filter("__v is not null")
    changes = changes.groupBy("season", "__day", "__v").agg(F.sum("d").alias("__delta")).filter("__delta <> 0")
    day = F.unix_date(F.col(DAY))
    requests = stored(requests, "requests")  # read once for the values asked for and once for the answers
    wanted = None
    for value in values.values():
        part = requests.filter(F.col(value).isNotNull()).select("season", day.alias("__day"), place(F.col(value)).alias("__v"))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = stored(wanted.distinct().withColumn("__b", F.shiftright("__v", BUCKET)), "asked")
    changes = stored(changes.withColumn("__b", F.shiftright("__v", BUCKET)), "changes")
    zero, highest = F.lit(0).cast("long").alias("__delta"), F.lit((10 ** PLACES >> BUCKET) + 1).cast("long")
    coarse = changes.groupBy("season", "__day", F.col("__b").alias("__v")).agg(F.sum("__delta").alias("__delta")).filter("__delta <> 0")
    coarse = coarse.unionByName(wanted.select("season", "__day", (F.col("__b") - 1).alias("__v"), zero).distinct())
    coarse = _asked(coarse.unionByName(wanted.select("season", "__day", highest.alias("__v"), zero).distinct()), ["season"])
    fine = changes.unionByName(wanted.select("season", "__day", "__v", "__b", zero))
    fine = _asked(fine, ["season", "__b"])
    lower = coarse.filter(F.col("__v") < highest).select("season", "__day", (F.col("__v") + 1).alias("__b"), F.col("__at_most").alias("lower"))
    every = coarse.filter(F.col("__v") == highest).select("season", "__day", F.col("__at_most").alias("all"))
    share = fine.join(lower, ["season", "__day", "__b"]).join(every, ["season", "__day"])
    share = stored(share.select("season", "__day", "__v", F.try_divide(100.0 * (F.col("lower") + F.col("__at_most")), F.col("all")).alias("share")), "shares")
    released(wanted, changes)
    out = requests.withColumn("__day", day)
    for k, (name, value) in enumerate(values.items()):
        if k:  # rows travel for one value at a time
            out = stored(out, "ranked")
            released(requests)
            requests = out
        out = out.withColumn("__v", place(F.col(value))).join(share.withColumnRenamed("share", name), ["season", "__day", "__v"], "left").drop("__v")
    return out.drop("__day")


STARTS = ("outs", "er", "hits", "walks", "k")
COUNTED = {"outs": "outs", "er": "er", "hits": "hits", "walks": "walks", "k": "k", "hr": "hr", "starts": "started"}


def _last_three(before: Mapping[str, Column]) -> Column:
    """A start's place and the sums of it and the two before."""
    at = [F.col(DAY).alias("d"), F.col("game_id").alias("g"), F.col("entity").alias("e")]
    return F.struct(*at, *[(F.coalesce(before[c], F.lit(0)) + F.col(c)).alias(c) for c in STARTS])


def _long_priors(logs: DataFrame, parts: int | None) -> DataFrame:
    """Logs with what came before, whatever a member has of them: sums per day, and stretches of starts."""
    key, tie = ["member"], [*TIE, "entity"]
    began = with_running(logs.filter("started > 0"), key, DAY, tie, parts=parts)
    began = with_trailing(began, key, {f"p_{c}": (2, lambda w, c=c: F.sum(c).over(w)) for c in STARTS}, parts=parts)
    recent = began.select("member", "game_id", "entity", _last_three({c: F.col(f"p_{c}") for c in STARTS}).alias("recent"))
    rows = logs.join(recent, ["member", "game_id", "entity"], "left")
    return with_running(rows, key, DAY, tie, running={**{f"c_{n}": run_sum(c) for n, c in COUNTED.items()}, "last3": run_max("recent")}, parts=parts)


def _snapshot() -> dict[str, Column]:
    o, r = F.col("c_outs"), F.col("last3")
    some = F.coalesce(o, F.lit(0)) > 0

    def rate(top: Column, scale: float, outs: Column) -> Column:
        return F.when(some & (outs > 0), top * scale / outs)

    return {"no_prior": (~some).cast("int"), "starts_pre": F.coalesce("c_starts", F.lit(0)), "ip_pre": F.coalesce(o, F.lit(0)) / 3.0,
            "era_pre": rate(F.col("c_er"), 27.0, o), "whip_pre": rate(F.col("c_hits") + F.col("c_walks"), 3.0, o),
            "k9_pre": rate(F.col("c_k"), 27.0, o), "bb9_pre": rate(F.col("c_walks"), 27.0, o), "hr9_pre": rate(F.col("c_hr"), 27.0, o),
            "recent3_ip_pre": F.when(some, F.coalesce(r["outs"], F.lit(0)) / 3.0).otherwise(0.0),
            "recent3_era_pre": rate(r["er"], 27.0, r["outs"]), "recent3_whip_pre": rate(r["hits"] + r["walks"], 3.0, r["outs"]),
            "recent3_k9_pre": rate(r["k"], 27.0, r["outs"])}


def _short_priors(logs: DataFrame, starters: DataFrame, parts: int | None) -> DataFrame:
    """Starters with what came before; all of a member's logs and starts are in one task, which is dealt them once.

    The starters travel among the logs. Each takes the snapshots of its member's logs of the contest, as a join by equality would.
    Logs without a day count as earlier than all others, but are no starts and have no snapshot.
    """
    given = logs.filter(F.col("member").isNotNull()).withColumn("asks", F.lit(False))
    rows = given.unionByName(starters.select("game_id", "entity", "member", F.lit(True).alias("asks")), allowMissingColumns=True)
    rows = rows.repartition(parts, "member") if parts else rows.repartition("member")
    place, began, dated = [DAY, *TIE, "entity"], F.col("started") > 0, F.col(DAY).isNotNull()
    known = F.col("game_id").isNotNull() & F.col("entity").isNotNull() & F.col("member").isNotNull()
    starts = Window.partitionBy("member", "began").orderBy(*place)
    same, earlier = Window.partitionBy("member", "game_id", "entity"), Window.partitionBy("member").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("began", F.coalesce(began & dated, F.lit(False)))
    rows = rows.withColumn("own", F.when(F.col("began") & known, _last_three({c: F.sum(c).over(starts.rowsBetween(-2, -1)) for c in STARTS})))
    # A log has a row for each start of its member in the contest.
    rows = rows.withColumn("starts", F.when(~F.col("asks") & known, F.collect_list("own").over(same)))
    rows = rows.withColumn("recent", F.explode_outer("starts")).drop("starts", "own")
    rows = rows.withColumns({**{f"c_{n}": F.sum(c).over(earlier) for n, c in COUNTED.items()}, "last3": F.max("recent").over(earlier)})
    found = _snapshot()
    snap = rows.select("member", "game_id", "entity", "asks", F.when(~F.col("asks") & dated, F.struct(*[v.alias(n) for n, v in found.items()])).alias("snap"))
    asked = snap.withColumn("snaps", F.when(known, F.collect_list("snap").over(same))).filter("asks")
    return asked.select("member", "game_id", "entity", F.explode_outer("snaps").alias("s")).select(
        "member", "game_id", "entity", *[F.col(f"s.{n}").alias(n) for n in found])


def pitcher_prior(logs: DataFrame, starters: DataFrame, parts: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Cumulative and last-three-starts rates of each starter before the contest.

    ``logs``: member, game_id, game_date, entity, started, outs, er, hits, walks, k, hr;
    ``starters``: game_id, entity, member. Members with up to ``stretch`` logs are dealt by member, once; those of the others,
    at most one in ``stretch`` logs, go by day. ``parts`` is the number of tasks, for large logs.
    """
    logs = stored(logs.select("member", "game_id", DAY, "entity", "started", "outs", "er", "hits", "walks", "k", "hr"), "logs")
    starters = starters.select("game_id", "entity", "member")
    long = stored(logs.groupBy("member").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > stretch) & F.col("member").isNotNull()).select("member"), "long")
    if long.isEmpty():
        out = _short_priors(logs, starters, parts)
    else:
        few, found = F.broadcast(long), _snapshot()
        snap = _long_priors(logs.join(few, "member", "left_semi"), parts).select("member", "game_id", "entity", *[v.alias(n) for n, v in found.items()])
        out = _short_priors(logs.join(few, "member", "left_anti"), starters.join(few, "member", "left_anti"), parts).unionByName(
            starters.join(few, "member", "left_semi").join(snap, ["member", "game_id", "entity"], "left"))
    return out.fillna({"no_prior": 1, "starts_pre": 0, "ip_pre": 0.0, "recent3_ip_pre": 0.0})


def infer_starter(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One starter per group with the evidence tier it was chosen by.

    Columns: member, api_flag, played, toi, shots.
    """
    api, played = F.col("api_flag") == 1, F.col("played") == 1
    tier = (F.when(api, 1).when(played & (F.col("toi") > 0), 2).when(played & (F.col("shots") > 0), 3)
            .when(played, 4).otherwise(5))
    plain = tier == 5
    rank = F.struct(tier.alias("tier"), F.when(plain, 0).otherwise(-F.col("played")).alias("a"), F.when(plain, 0).otherwise(-F.col("toi")).alias("b"),
                    F.when(plain, 0).otherwise(-F.col("shots")).alias("c"), F.col("member").alias("member"))
    best = rows.groupBy(*group).agg(F.min(rank).alias("r"), F.count(F.when(api, 1)).alias("flags"))
    # Evidence names and confidences by tier.
    names = {2: ("inferred_played_toi", 0.9), 3: ("inferred_played_shots_against", 0.8), 4: ("inferred_played_fallback", 0.65), 5: ("inferred_roster_fallback", 0.5)}
    source, conf = F.when(F.col("flags") == 1, "api_flag").when(F.col("flags") > 1, "api_flag_conflict_resolved"), F.when(F.col("flags") == 1, 1.0).when(F.col("flags") > 1, 0.75)
    for k, (n, c) in names.items():
        source, conf = source.when(F.col("r.tier") == k, n), conf.when(F.col("r.tier") == k, c)
    return best.select(*group, F.col("r.member").alias("member"), source.alias("source"), conf.alias("confidence"))


# The weights of a likely starter's evidence, what rest adds after back-to-back days, and the usual quality of the others.
STARTER_WEIGHTS = {"role": 0.48, "api": 0.20, "source": 0.12, "rate10": 0.12, "rate5": 0.06, "rested": 0.10}
TIRED = {"one day": -0.18, "two days": 0.10, "unknown": -0.05}
USUAL_QUALITY = 0.905


def starter_certainty(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Likely starter per group, its softmax certainty and its quality gap to the others.

    Columns: member, role, api, source (0/1), rate5, rate10, rest_days, back_to_back, quality.
    """
    rest = F.col("rest_days")
    tired = F.when(rest <= 1, TIRED["one day"]).when(rest >= 2, TIRED["two days"]).otherwise(TIRED["unknown"])
    given = {"role": F.col("role"), "api": F.col("api"), "source": F.col("source"), "rate10": F.coalesce("rate10", F.lit(0.0)),
             "rate5": F.coalesce("rate5", F.lit(0.0)), "rested": F.coalesce(clamp(rest / 4.0, 0.0, 1.0), F.lit(0.0))}
    raw = sum((STARTER_WEIGHTS[c] * v for c, v in given.items()), F.lit(0.0)) + F.when(F.col("back_to_back") >= 1, tired).otherwise(0.0)
    scored = rows.withColumn("score", clamp(raw, 0.0, 1.0))
    top = F.max(F.struct("score", (-F.col("member")).alias("m"), "quality")).alias("top")
    out = scored.groupBy(*group).agg(top, F.sum(F.exp("score")).alias("z"), F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"))
    others = F.try_divide(F.col("q") - F.col("top.quality"), F.col("n") - 1)
    return out.select(*group, (-F.col("top.m")).alias("member"), F.col("top.score").alias("score"),
                      (F.exp("top.score") / F.col("z")).alias("certainty"),
                      (F.col("top.quality") - F.coalesce(others, F.lit(USUAL_QUALITY))).alias("quality_gap"))


def weighted_index(df: DataFrame, weights: Mapping[str, tuple[float, float]], name: str) -> DataFrame:
    """Sum of weight * (value - offset); a missing value contributes nothing."""
    total = F.lit(0.0)
    for c, (w, offset) in weights.items():
        total = total + F.coalesce((F.col(c) - offset) * w, F.lit(0.0))
    return df.withColumn(name, total)


def form_adjusted(members: DataFrame, log: DataFrame) -> DataFrame:
    """Post-contest form score less the opponent's rate at the time, rolled forward."""
    score = members.groupBy("game_id", "entity").agg((1.8 * F.avg("points")).alias("form_score"))
    rates = with_running(log.filter("win is not null"), ["entity", "season"], DAY, TIE, running={"w": run_sum("win")})
    rates = rates.select("game_id", "entity", "opponent", DAY, "season", F.try_divide("w", F.col("seq") - 1).alias("pct"))
    opp = rates.select("game_id", F.col("entity").alias("opponent"), F.col("pct").alias("opp_pct"))
    rows = rates.drop("pct").join(opp, ["game_id", "opponent"]).join(score, ["game_id", "entity"])
    rows = rows.withColumn("adjusted", F.col("form_score") - F.col("opp_pct"))
    rows = with_running(rows, ["entity"], DAY, TIE)
    return with_trailing(rows, ["entity"], {
        "form_adj_last5": (5, mean_of("adjusted")), "form_adj_last10": (10, mean_of("adjusted")),
        "form_var_last5": (5, lambda w: F.var_pop("form_score").over(w)), "form_ewm": (10, ewm_of("form_score", 0.45))})


CORE_OUT = "game_id long, active int, core int, retained int, key_present int, absent int"
CORE_STATE = "member long, recent array<double>"


class _Core:
    """Fold of ``core_retention``: the means of members lie in a heap, so a contest costs its core and its rows, not all members.

    An entry of the heap counts if it is the member's mean of now; the heap is made anew when most do not. A member or a value that is
    null has no place in an order; an entity with one is ranked from all its members.
    """

    def __init__(self, core: int, keys: int, kept: int, state: Iterable[tuple]):
        self.core, self.keys, self.kept = core, keys, kept
        self.recent = {_known(m): list(v) for m, v in state}
        self.mean = {m: sum(v) / len(v) for m, v in self.recent.items()}
        self.odd = any(m != m or v != v for m, v in self.mean.items())
        self.heap, self.game, self.rows = self._heap(), None, []

    def _heap(self) -> list[tuple]:
        heap = [] if self.odd else [(-v, m) for m, v in self.mean.items()]
        heapq.heapify(heap)
        return heap

    def _best(self) -> list:
        if self.odd:
            return [m for _, m in heapq.nsmallest(self.core, ((-v, m) for m, v in self.mean.items()))]
        best, seen = [], set()
        while self.heap and len(best) < self.core:
            entry = heapq.heappop(self.heap)
            if entry[1] not in seen and -entry[0] == self.mean[entry[1]]:
                best.append(entry)
                seen.add(entry[1])
        for entry in best:
            heapq.heappush(self.heap, entry)
        return [m for _, m in best]

    def row(self, day, game, member, points):
        out = self.end() if game != self.game else []
        self.game = game
        self.rows.append((_known(member), _known(points)))
        return out

    def end(self):
        if not self.rows:
            return []
        best, here = self._best(), {m for m, _ in self.rows}
        held = len(set(best) & here)
        out = [(self.game, len(here), len(best), held, len(set(best[:self.keys]) & here), len(best) - held)]
        for m, x in self.rows:
            past = self.recent.setdefault(m, [])
            past.append(float(x))
            del past[:-self.kept]
            self.mean[m] = mean = sum(past) / len(past)
            self.odd = self.odd or m != m or mean != mean
            heapq.heappush(self.heap, (-mean, m))
        if len(self.heap) > 2 * len(self.mean) + 100:
            self.heap = self._heap()
        self.rows = []
        return out

    def state(self):
        return [(None if m != m else m, v) for m, v in self.recent.items()]


def _known(value):
    return float("nan") if value is None else value


def core_retention(members: DataFrame, core: int = 14, keys: int = 6, kept: int = 8, max_rows: int = MAX_ROWS) -> DataFrame:
    """How much of the expected core (best recent contributors so far) plays in each contest."""
    out, _ = chunked_fold(members.select("entity", DAY, "game_id", "member", "points"), ["entity"], DAY, [DAY, "game_id", "member"],
                          lambda state: _Core(core, keys, kept, state), CORE_OUT, CORE_STATE, max_rows)
    return out.withColumn("retention", F.try_divide("retained", "core"))
