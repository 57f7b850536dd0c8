"""Derived feature columns: deltas, interactions, box rates, state maps."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from boutline.functions.odds import clamp, logit


def add_deltas(df: DataFrame, a: str = "home_", b: str = "away_", out: str = "diff_") -> DataFrame:
    """NULL-propagating difference for every numeric column pair."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")}
    stems = [c[len(a):] for c in df.columns if c in numeric and c.startswith(a) and b + c[len(a):] in numeric]
    return df.withColumns({out + s: F.col(a + s) - F.col(b + s) for s in stems})


def interactions(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Named SQL expressions over feature columns; an absent or NULL input counts as 0."""
    import re

    words = {w for e in spec.values() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", e)}
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer")}
    functions = {"abs", "sqrt", "ln", "greatest", "least", "ln1p", "log1p", "exp", "cast", "as", "double"}
    inputs = {}
    for w in sorted(words - functions):
        inputs[w] = F.coalesce(F.col(w).cast("double"), F.lit(0.0)) if w in numeric else F.lit(0.0)
    packed = df.withColumn("__in", F.struct(*[v.alias(k) for k, v in inputs.items()]))
    cols = {n: F.expr(re.sub(r"\b(" + "|".join(inputs) + r")\b", r"__in.\1", e)) for n, e in spec.items()}
    return packed.withColumns(cols).drop("__in")


def box_rates(points, opp_points, fgm, fga, tpm, tpa, fta, oreb, dreb, opp_dreb, rebounds, opp_rebounds, turnovers,
              opp_possessions=None) -> dict[str, Column]:
    """Possession estimate and rates of a box score; the defensive rating uses the side's own possessions."""
    poss = fga + 0.44 * fta + turnovers - oreb
    out = {
        "possessions": poss, "off_rating": 100.0 * F.try_divide(points, poss),
        "def_rating": 100.0 * F.try_divide(opp_points, poss), "efg": F.try_divide(fgm + 0.5 * tpm, fga),
        "three_rate": F.try_divide(tpa, fga), "reb_rate": F.try_divide(rebounds, rebounds + opp_rebounds),
        "oreb_rate": F.try_divide(oreb, oreb + opp_dreb), "tov_rate": F.try_divide(turnovers, poss)}
    if opp_possessions is not None:
        out["def_rating_opp"] = 100.0 * F.try_divide(opp_points, opp_possessions)
    return out


def state_features(margin, frac, pregame=None, overtime=None, outs=None, offense_is_home=None, down=None,
                   distance=None, yards=None) -> dict[str, Column]:
    """Feature map of an in-contest state; unobserved inputs are neutral and carry a flag."""
    none = F.lit(None)
    f = clamp(frac, 0.0, 1.0)
    m = margin.cast("double")
    prior = F.coalesce(logit(pregame), F.lit(0.0)) if pregame is not None else F.lit(0.0)
    outs = none.cast("int") if outs is None else outs
    off = none.cast("boolean") if offense_is_home is None else offense_is_home
    down = none.cast("int") if down is None else down
    distance = none.cast("int") if distance is None else distance
    yards = none.cast("int") if yards is None else yards
    known = off.isNotNull() & yards.isNotNull()
    side = F.when(off, 1.0).otherwise(-1.0)
    return {
        "margin": m, "margin_scaled": m / F.sqrt(f + 1e-6), "frac_remaining": f, "pregame_logit": prior,
        "pregame_logit_decay": prior * f,
        "is_overtime": (F.lit(0.0) if overtime is None else overtime.cast("double")),
        "outs": F.coalesce(outs.cast("double"), F.lit(0.0)), "outs_known": outs.isNotNull().cast("double"),
        "offense_is_home": F.when(off.isNull(), 0.5).otherwise(off.cast("double")),
        "down": F.coalesce(down.cast("double"), F.lit(0.0)), "distance": F.coalesce(distance.cast("double"), F.lit(0.0)),
        "yards_to_endzone": F.coalesce(yards.cast("double"), F.lit(50.0)),
        "field_position_home": F.when(known, side * (100.0 - yards.cast("double"))).otherwise(0.0),
        "situation_known": (known & down.isNotNull()).cast("double")}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), market: bool = True) -> list[str]:
    """Numeric feature names; without ``market`` names that carry prices are left out."""
    # Name parts of market-derived features.
    parts = ["moneyline", "spread", "total_line", "market", "odds"]
    return [f.name for f in df.schema
            if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name not in exclude
            and (market or not any(p in f.name for p in parts))]
