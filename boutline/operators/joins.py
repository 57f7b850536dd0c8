"""Joins of the contest model."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.functions.cleaning import norm_words


def canonicalize(df: DataFrame, code: str, aliases: DataFrame, era: tuple[Column, list[str], str] | None = None) -> DataFrame:
    """Replace a code by its canonical name; ``aliases`` holds (canonical, pipe-separated aliases).

    ``era`` gives (rule, codes, name) that overrides the table while the rule holds.
    """
    table = (aliases.select("canonical", F.explode(F.split("aliases", r"\|")).alias("__a"))
             .select(F.upper(F.trim("__a")).alias("__alias"), "canonical")
             .filter("__alias <> ''").dropDuplicates(["__alias"]))
    key = F.upper(F.trim(F.col(code)))
    out = df.join(table, key == F.col("__alias"), "left")
    name = F.coalesce("canonical", key)
    if era is not None:
        rule, codes, old = era
        name = F.when(rule & key.isin(codes), old).otherwise(name)
    return out.withColumn("canonical", name).drop("__alias")


def resolve_entity(df: DataFrame, text: str, dim: DataFrame) -> DataFrame:
    """Entity of a free text: exact code, else exact name, else a name prefix only one entity has.

    Prefixes are looked up by equality against the expanded prefixes of each name.
    """
    names = dim.select("entity", F.col("entity").cast("string").alias("code"), norm_words("name").alias("nn"))
    by_code = names.select("code", F.col("entity").alias("e_code"))
    by_name = names.groupBy(F.col("nn").alias("name_key")).agg(F.min("entity").alias("e_name"))
    by_prefix = (names.select("entity", F.explode(F.transform(F.sequence(F.lit(1), F.length("nn")),
                                                             lambda i: F.substring("nn", F.lit(1), i))).alias("prefix"))
                 .groupBy("prefix").agg(F.count(F.lit(1)).alias("hits"), F.min("entity").alias("e_prefix"))
                 .filter("hits = 1").drop("hits"))
    out = (df.withColumn("__q", norm_words(text))
           .join(by_code, F.trim(F.lower(F.col(text))) == F.col("code"), "left")
           .join(by_name, F.col("__q") == F.col("name_key"), "left")
           .join(by_prefix, F.col("__q") == F.col("prefix"), "left"))
    how = (F.when(F.col("e_code").isNotNull(), "code").when(F.col("e_name").isNotNull(), "name")
           .when(F.col("e_prefix").isNotNull(), "prefix"))
    return out.withColumns({"entity": F.coalesce("e_code", "e_name", "e_prefix"), "how": how})


def confidence_label(p: Column, cuts: Sequence[tuple[str, float]], rest: str) -> Column:
    """First label whose distance from 0.5 is reached; cuts go from far to near."""
    gap = F.abs(p - 0.5)
    out = F.when(gap >= cuts[0][1], cuts[0][0])
    for name, cut in cuts[1:]:
        out = out.when(gap >= cut, name)
    return out.otherwise(rest)


def attach_sides(games: DataFrame, features: DataFrame, on: Sequence[str] = (), key: str = "entity") -> DataFrame:
    """Join entity features twice, as home_* and away_*."""
    names = [c for c in features.columns if c != key and c not in on]
    out = games
    for side in ("home", "away"):
        view = features.select(F.col(key).alias(side), *on, *[F.col(c).alias(f"{side}_{c}") for c in names])
        out = out.join(view, [side, *on], "left")
    return out


def opponent_stats(rows: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """Own and opponent statistics of each entity row."""
    names = [c for c in stats.columns if c not in on and c != "entity"]
    opp = stats.select(*on, F.col("entity").alias("opponent"), *[F.col(c).alias(f"opp_{c}") for c in names])
    return rows.join(stats, [*on, "entity"], "left").join(opp, [*on, "opponent"], "left")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that fails when the right side repeats a key."""
    n = F.count(F.lit(1))
    names = [c for c in right.columns if c not in on]
    checked = right.groupBy(*on).agg(
        F.when(n > 1, F.raise_error(F.lit("join key is not unique"))).otherwise(F.first(F.struct(*names))).alias("__r"))
    return left.join(checked, list(on), "left").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in names])


def previous_present(df: DataFrame, entity: str, season: str, values: Sequence[str], step: str = "present") -> DataFrame:
    """Values of the previous season: the previous one in the data, or exactly season-1 (NULL otherwise)."""
    if step == "present":
        # The season before this one among all seasons of the data, whether or not the entity played it.
        seasons = df.select(season).distinct()
        prev = seasons.select(season, F.lag(season).over(Window.orderBy(season)).alias("__prev"))
    else:
        prev = df.select(season).distinct().withColumn("__prev", F.col(season) - 1)
    past = df.select(entity, F.col(season).alias("__prev"), *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.join(prev, season).join(past, [entity, "__prev"], "left").drop("__prev")


def fill_signal(df: DataFrame, signal: DataFrame, on: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Left join an external signal and fill what is missing."""
    return df.join(signal, list(on), "left").fillna(defaults)


def reconcile(derived: DataFrame, published: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows where the two sources disagree, or only one has the key."""
    d = derived.select(*on, *[F.col(v).alias(f"d_{v}") for v in values], F.lit(1).alias("in_d"))
    p = published.select(*on, *[F.col(v).alias(f"p_{v}") for v in values], F.lit(1).alias("in_p"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"d_{v}").eqNullSafe(F.col(f"p_{v}"))
    return d.join(p, list(on), "full").filter(~(same & F.col("in_d").isNotNull() & F.col("in_p").isNotNull()))


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of ``row`` to every row; anything but one row in it is an error."""
    one = row.agg(F.count(F.lit(1)).alias("__k"), F.first(F.struct("*")).alias("__r"))
    checked = F.when(F.col("__k") == 1, F.col("__r")).otherwise(F.raise_error(F.concat(F.lit("one row expected, not "), F.col("__k").cast("string"))))
    return df.join(F.broadcast(one.select(checked.alias("__r")))).select("*", "__r.*").drop("__r")
