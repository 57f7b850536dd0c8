"""Elo ratings and strength models."""

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from boutline.functions.odds import clamp, logit, sigmoid
from boutline.operators.aggregates import best_candidate
from boutline.operators.fold import MAX_ROWS, chunked_fold
from boutline.operators.quantiles import robust_stats

OUT = "game_id long, season int, game_date date, home long, away long, home_elo double, away_elo double, prob double, home_post double, away_post double, y double"
STATE = "entity long, rating double, last_season int, games long, wins double, margin double, is_season boolean"


@dataclass(frozen=True)
class EloParams:
    """k and home edge; carry is the share of the distance to the mean kept at a new season.

    margin: none, capped (K grows 10% per point up to 5), log (log margin damped by the rating gap)
    or log1p (log margin plus one).
    """

    k: float = 20.0
    home: float = 65.0
    carry: float = 1.0
    mean: float = 1500.0
    margin: str = "none"
    form_win: float = 0.0
    form_margin: float = 0.0


# Rating presets, named by what sets them apart.
PLAIN = EloParams()
CARRY = EloParams(k=20.0, home=55.0, carry=0.67)
FORM = EloParams(k=18.0, home=55.0, carry=0.75, margin="capped", form_win=120.0, form_margin=35.0)
MARGIN = EloParams(k=20.0, home=55.0, carry=0.75, margin="log")


def _k_scale(p: EloParams, margin: float, winner_gap: float) -> float:
    size = abs(margin)
    if p.margin == "capped":
        return 1.0 + 0.1 * min(size, 5.0)
    if p.margin == "log":
        return math.log(max(size, 1.0) + 1.0) * 2.2 / (winner_gap * 0.001 + 2.2)
    if p.margin == "log1p":
        return math.log(size + 1.0) + 1.0
    return 1.0


class Ratings:
    """Ratings of one group; entities regress lazily when they meet a new season."""

    def __init__(self, p: EloParams, state: Iterable[tuple]):
        self.p = p
        self.table: dict[int, list] = {}
        self.seasons: list[int] = []
        # Seasons the group has seen travel in the state as rows of their own.
        for entity, *own, is_season in state:
            if is_season:
                self.seasons.append(own[1])
            else:
                self.table[entity] = own
        self.seasons.sort()

    def at(self, entity: int, season: int) -> list:
        v = self.table.get(entity)
        if v is None:
            v = self.table[entity] = [self.p.mean, season, 0, 0.0, 0.0]
        elif v[1] != season:
            # One step per season boundary the group crossed since this entity's last contest.
            steps = len([s for s in self.seasons if v[1] < s <= season])
            v[0] = self.p.mean + self.p.carry ** steps * (v[0] - self.p.mean)
            v[1:] = [season, 0, 0.0, 0.0]
        return v

    def play(self, season: int, home: int, away: int, margin: float, neutral: bool):
        if not self.seasons or self.seasons[-1] != season:
            self.seasons.append(season)
        p, h, a = self.p, self.at(home, season), self.at(away, season)
        edge = 0.0 if neutral else p.home
        gap = h[0] - a[0] + edge
        if p.form_win or p.form_margin:
            gap += p.form_win * (_per(h[3], h[2], 0.5) - _per(a[3], a[2], 0.5))
            gap += p.form_margin * (_per(h[4], h[2], 0.0) - _per(a[4], a[2], 0.0))
        prob = 1.0 / (1.0 + 10.0 ** (-gap / 400.0))
        before = h[0], a[0]
        if margin != margin:  # not played
            return (*before, prob, *before, None)
        actual = 0.5 if margin == 0 else float(margin > 0)
        winner_gap = (h[0] - a[0]) if margin > 0 else (a[0] - h[0])
        change = p.k * _k_scale(p, margin, winner_gap) * (actual - prob)
        h[0] += change
        a[0] -= change
        for v, won, m in ((h, actual, margin), (a, 1.0 - actual, -margin)):
            v[2] += 1
            v[3] += won
            v[4] += m
        return (*before, prob, h[0], a[0], None if margin == 0 else actual)

    def state(self) -> Iterator[tuple]:
        """(entity, rating, last_season, games, wins, margin, is_season) of entities, and of the seasons seen."""
        yield from ((e, *v, False) for e, v in self.table.items())
        yield from ((0, 0.0, s, 0, 0.0, 0.0, True) for s in self.seasons)


def _per(total: float, n: int, empty: float) -> float:
    return total / n if n else empty


ORDER = ["season", "game_date", "game_id"]


class _Rated:
    """Fold of ``elo``: a rated contest for each contest."""

    def __init__(self, params: EloParams, state: Iterable[tuple]):
        self.ratings = Ratings(params, state)

    def row(self, season, day, game, home, away, margin, neutral=False):
        result = self.ratings.play(season, home, away, float("nan") if margin is None else float(margin), bool(neutral))
        return [(game, season, day, home, away, *result)]

    def end(self):
        return []

    def state(self):
        return self.ratings.state()


def elo(games: DataFrame, params: EloParams, by: Sequence[str] = ("league",),
        max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Pregame ratings and probability of every contest, and the final ratings.

    ``games`` has season, game_date, game_id, home, away, margin (NULL when unplayed) and optionally neutral.
    """
    cols = [*by, *ORDER, "home", "away", "margin"]
    if "neutral" in games.columns:
        cols.append("neutral")
    rated, state = chunked_fold(games.select(*cols), by, "game_date", ORDER, lambda rows: _Rated(params, rows), OUT, STATE, max_rows)
    return rated, state.filter("not is_season").drop("is_season")


GRID_OUT = "config_id int, n long, accuracy double, log_loss double, brier double"
GRID_STATE = "entity long, rating array<double>, last_season int, games long, wins double, margin double, is_season boolean"


class _Tried:
    """Fold of ``grid_metrics``: all parameter sets as one vector, and sums per set at the end."""

    def __init__(self, grid: Sequence[EloParams], state: Iterable[tuple]):
        self.grid, self.first = grid, grid[0]
        self.k, self.home, self.form_win, self.form_margin = (np.array([getattr(p, f) for p in grid]) for f in ("k", "home", "form_win", "form_margin"))
        # A list of numbers takes four times the memory of an array.
        self.ratings = Ratings(self.first, ((e, np.asarray(rating), *rest) for e, rating, *rest in state))
        self.n, self.total = 0, np.zeros((3, len(grid)))

    def row(self, s, day, game, hid, aid, m):
        r, first = self.ratings, self.first
        if not r.seasons or r.seasons[-1] != s:
            r.seasons.append(s)
        h, a = r.at(hid, s), r.at(aid, s)
        gap = (h[0] - a[0] + self.home + self.form_win * (_per(h[3], h[2], 0.5) - _per(a[3], a[2], 0.5))
               + self.form_margin * (_per(h[4], h[2], 0.0) - _per(a[4], a[2], 0.0)))
        p = 1.0 / (1.0 + 10.0 ** (-gap / 400.0))
        won = 1.0 if m > 0 else 0.0
        if m != 0:
            q = np.clip(p if won else 1.0 - p, 1e-6, 1.0 - 1e-6)
            self.total += np.stack([(p >= 0.5) == bool(won), -np.log(q), (p - won) ** 2])
            self.n += 1
        actual = won if m else 0.5
        scale = _k_scale(first, m, 0.0) if first.margin != "log" else np.array(
            [_k_scale(first, m, g) for g in ((h[0] - a[0]) if m > 0 else (a[0] - h[0])) + np.zeros(len(self.grid))])
        change = self.k * scale * (actual - p)
        h[0], a[0] = h[0] + change, a[0] - change
        for v, w, d in ((h, actual, m), (a, 1.0 - actual, -m)):
            v[2] += 1
            v[3] += w
            v[4] += d
        return []

    def end(self):
        return [(i, self.n, *map(float, self.total[:, i])) for i in range(len(self.grid))]

    def state(self):
        return ((e, (np.zeros(len(self.grid)) + rating).tolist(), *rest) for e, rating, *rest in self.ratings.state())


def grid_metrics(games: DataFrame, grid: Sequence[EloParams], by: Sequence[str] = ("league",),
                 max_rows: int = MAX_ROWS) -> DataFrame:
    """Metrics of every parameter set; a contest updates all sets at once as one vector.

    Only sums per set leave a task.  The sets share the margin rule, the carry and the mean.
    """
    first = grid[0]
    if any((p.margin, p.carry, p.mean) != (first.margin, first.carry, first.mean) for p in grid):
        raise ValueError("a grid varies k, home and the form weights only")
    rows = games.filter("margin is not null").select(*by, *ORDER, "home", "away", "margin")
    sums, _ = chunked_fold(rows, by, "game_date", ORDER, lambda state: _Tried(grid, state), GRID_OUT, GRID_STATE, max_rows)
    n = F.sum("n")
    return sums.groupBy(*by, F.col("config_id").alias("model_id")).agg(
        n.alias("n"), *[(F.sum(c) / n).alias(c) for c in ("accuracy", "log_loss", "brier")])


def tune_elo(games: DataFrame, grid: Sequence[EloParams], by: Sequence[str] = ("league",)) -> DataFrame:
    """The best parameter set per group by log loss."""
    return best_candidate(grid_metrics(games, grid, by), by)


def latest_ratings(rated: DataFrame, by: Sequence[str] = ("league",)) -> DataFrame:
    """Newest rating per entity, from the rated contests."""
    at = F.struct("game_date", "game_id")
    sides = rated.select(*by, at.alias("at"), F.inline(F.array(
        F.struct(F.col("home").alias("entity"), F.col("home_post").alias("post")),
        F.struct(F.col("away").alias("entity"), F.col("away_post").alias("post")))))
    return sides.groupBy(*by, "entity").agg(F.max_by("post", "at").alias("rating"), F.count(F.lit(1)).alias("games"))


# Blend weights of the strength score and of the pair probability.
SEASON_BLEND, RECENT_BLEND_MAX, PRIOR_BLEND = 0.5, 0.22, 0.33
HOME_LOGIT, POINTS_WEIGHT, MARGIN_WEIGHT, SHRINK, TEMPERATURE = 0.18, 0.65, 0.35, 0.6, 1.8


def strength(profiles: DataFrame, season_weights: Mapping[str, float], recent_weights: Mapping[str, float],
             prior: str = "prior", by: Sequence[str] = ()) -> DataFrame:
    """Weighted robust z-scores per entity, among those of the same ``by``; the recent part counts by how much of it is known."""
    names, by = [*season_weights, *recent_weights], list(by)
    stats = robust_stats(profiles, names, "spread", by)
    wide = stats.groupBy(*by).agg(*[x for n in names for x in (
        F.max(F.when(F.col("name") == n, F.col("median"))).alias(f"__m_{n}"),
        F.max(F.when(F.col("name") == n, F.col("scale"))).alias(f"__s_{n}"))])
    rows = profiles.join(wide, by) if by else profiles.join(F.broadcast(wide))

    def z(n: str) -> Column:
        return clamp((F.coalesce(F.col(n), F.col(f"__m_{n}")) - F.col(f"__m_{n}")) / F.col(f"__s_{n}"), -3.0, 3.0)

    season = sum((w * z(n) for n, w in season_weights.items()), F.lit(0.0))
    recent = sum((w * z(n) for n, w in recent_weights.items()), F.lit(0.0))
    known = sum((F.col(n).isNotNull().cast("int") for n in recent_weights), F.lit(0)) / float(max(len(recent_weights), 1))
    out = rows.withColumns({"season_score": season, "recent_score": recent, "coverage": known,
                            "prior_logit": logit(clamp(prior, 0.05, 0.95), 1e-4)})
    return out.withColumn("strength", SEASON_BLEND * F.col("season_score")
                          + RECENT_BLEND_MAX * F.col("coverage") * F.col("recent_score")
                          + PRIOR_BLEND * F.col("prior_logit")).drop(*[c for c in wide.columns if c not in by])


def pair_probability(pairs: DataFrame, profiles: DataFrame, location: str = "home", by: Sequence[str] = ()) -> DataFrame:
    """Win probability of the first side of each requested pair, from the profiles of the same ``by``.

    ``profiles`` has entity, strength, home_pct, road_pct, home_margin, road_margin; pairs are looked up,
    never generated.
    """
    from boutline.operators.joins import attach_sides

    rows = attach_sides(pairs, profiles.select(*by, "entity", "strength", "home_pct", "road_pct", "home_margin", "road_margin"), by)
    base = F.col("home_strength") - F.col("away_strength")
    if location == "neutral":
        edge = F.lit(0.0)
    else:
        mine, theirs, sign = ("home", "road", 1.0) if location == "home" else ("road", "home", -1.0)
        edge = (sign * HOME_LOGIT + POINTS_WEIGHT * (F.col(f"home_{mine}_pct") - F.col(f"away_{theirs}_pct"))
                + MARGIN_WEIGHT * (F.col(f"home_{mine}_margin") - F.col(f"away_{theirs}_margin")))
    p = sigmoid((base + edge) * SHRINK / TEMPERATURE)
    return rows.withColumns({"base_diff": base, "location_edge": edge, "p_home": p, "confidence": F.abs(p - 0.5) * 2.0})


def with_overrides(profiles: DataFrame, overrides: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """What-if: add an adjustment to one profile column of some entities."""
    adj = overrides.select(*by, "entity", F.col("adjust").alias("__adj"))
    return (profiles.join(adj, [*by, "entity"], "left")
            .withColumn(column, F.coalesce(F.col(column), F.lit(0.0)) + F.coalesce("__adj", F.lit(0.0))).drop("__adj"))
