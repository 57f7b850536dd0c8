"""Nested JSON documents to flat rows.  Every flattener takes a text column ``doc``."""

from pyspark.sql import Column, DataFrame, functions as F

from boutline.functions.cleaning import as_int
from boutline.functions.clocks import clock_seconds, frac_remaining_clock
from boutline.functions.geo import local_date
from boutline.functions.status import played_score, status_from_state

# Document shapes.
SCOREBOARD = ("events array<struct<id string, date string, competitions array<struct<type struct<abbreviation string>, "
              "status struct<type struct<state string, name string, shortDetail string>>, "
              "competitors array<struct<homeAway string, score string, team struct<abbreviation string, displayName string>>>>>>>")
PLAYER = "array<struct<playerId long, name string, position string, goals int, points int, toi string, shotsAgainst int>>"
SIDE = f"struct<abbrev string, forwards {PLAYER}, defense {PLAYER}, goalies {PLAYER}>"
BOXSCORE = f"id long, season int, homeTeam {SIDE}, awayTeam {SIDE}"
SCHEDULE = ("dates array<struct<date string, games array<struct<gamePk long, gameType string, gameDate string, "
            "status struct<detailedState string, abstractGameState string>, "
            "teams struct<home struct<score int, team struct<id long>>, away struct<score int, team struct<id long>>>>>>>")
SPLITS = "stats array<struct<type string, splits array<struct<season string, gameType string, player struct<id long>, team struct<id long>, game struct<gamePk long>, stat string>>>>"
STANDINGS = ("records array<struct<division string, teamRecords array<struct<team struct<id long, name string>, wins int, losses int, "
             "runsScored double, runsAllowed double>>>>")
PLAY = "struct<id string, period struct<number int, type string>, clock struct<displayValue string>, homeScore int, awayScore int>"
SITUATION = (PLAY[:-1] + ", sequenceNumber string, isTurnover boolean, type struct<text string>, start struct<team struct<id string>, down int, distance int, "
             "yardLine int, yardsToEndzone int, downDistanceText string>, end struct<downDistanceText string>>")
SUMMARY = (f"id string, plays array<{PLAY}>, drives struct<previous array<struct<plays array<{PLAY}>>>, current array<struct<plays array<{PLAY}>>>>, "
           "winprobability array<struct<playId string, homeWinPercentage double>>")


def parse(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("j", F.from_json("doc", schema))


def _side(competitors: Column, side: str) -> Column:
    return F.try_element_at(F.filter(competitors, lambda c: c["homeAway"] == side), F.lit(1))


def flatten_scoreboard(docs: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """One contract row per event; exhibitions and events without both sides are dropped."""
    ev = parse(docs, SCOREBOARD).select(F.explode("j.events").alias("e"))
    c = ev.select("e.id", "e.date", F.try_element_at("e.competitions", F.lit(1)).alias("c")).filter("c is not null")
    rows = c.select(
        F.col("id").alias("game_id"), F.to_timestamp("date").alias("start"), F.upper("c.type.abbreviation").alias("kind"),
        status_from_state("c.status.type.state", "c.status.type.name").alias("status"),
        _side(F.col("c.competitors"), "home").alias("h"), _side(F.col("c.competitors"), "away").alias("a"))
    rows = rows.filter((F.coalesce("kind", F.lit("")) != "ALLSTAR") & F.col("h.team.abbreviation").isNotNull()
                       & F.col("a.team.abbreviation").isNotNull())
    return rows.select("game_id", "start", local_date("start", zone).alias("game_date"), "status",
                       F.col("h.team.abbreviation").alias("home"), F.col("a.team.abbreviation").alias("away"),
                       played_score(as_int("h.score"), "status").alias("home_score"),
                       played_score(as_int("a.score"), "status").alias("away_score"))


def flatten_boxscore(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roster rows and stat rows of box scores."""
    j = parse(docs, BOXSCORE).select("j.*")

    def team(side: str) -> Column:
        def tagged(group: str, goalie: int) -> Column:
            return F.coalesce(F.transform(F.col(f"{side}.{group}"), lambda p: F.struct(
                p.alias("p"), F.lit(group).alias("unit"), F.lit(goalie).alias("is_goalie"))), F.array().cast(
                    "array<struct<p struct<playerId long, name string, position string, goals int, points int, toi string, shotsAgainst int>, unit string, is_goalie int>>"))
        return F.struct(F.col(f"{side}.abbrev").alias("team"), F.lit(side[:4]).alias("side"),
                        F.concat(tagged("forwards", 0), tagged("defense", 0), tagged("goalies", 1)).alias("players"))

    rows = (j.select("id", "season", F.explode(F.array(team("homeTeam"), team("awayTeam"))).alias("t"))
            .select("id", "season", "t.team", "t.side", F.explode("t.players").alias("x")))
    key = [F.col("id").alias("game_id"), "season", "team", F.col("x.p.playerId").alias("member")]
    toi = clock_seconds("x.p.toi").cast("int")
    roster = rows.select(*key, "side", F.col("x.p.position").alias("position"), "x.is_goalie", (F.coalesce(toi, F.lit(0)) > 0).cast("int").alias("played"))
    stats = rows.select(*key, F.col("x.p.goals").alias("goals"), F.col("x.p.points").alias("points"), toi.alias("toi_seconds"),
                        F.col("x.p.shotsAgainst").alias("shots_against"))
    return roster, stats


def flatten_schedule(docs: DataFrame) -> DataFrame:
    g = (parse(docs, SCHEDULE).select(F.explode("j.dates").alias("d"))
         .select("d.date", F.explode("d.games").alias("g")))
    return g.select(F.col("g.gamePk").alias("game_id"), F.to_date("date").alias("game_date"), F.col("g.gameType").alias("game_type"),
                    F.col("g.teams.home.team.id").alias("home"), F.col("g.teams.away.team.id").alias("away"),
                    F.col("g.teams.home.score").alias("home_score"), F.col("g.teams.away.score").alias("away_score"),
                    F.col("g.status.detailedState").alias("detailed"))


def _splits(docs: DataFrame) -> DataFrame:
    return parse(docs, SPLITS).select(F.explode("j.stats").alias("s")).select("s.type", F.explode("s.splits").alias("p"))


def flatten_stat_splits(docs: DataFrame, group: str, fields: dict[str, str]) -> DataFrame:
    """Wide statistics of one group; the whole statistic blob stays as text."""
    rows = _splits(docs).filter(F.col("type") == group)
    return rows.select(F.col("p.season").cast("int").alias("season"), F.col("p.player.id").alias("member"), F.col("p.team.id").alias("team"),
                       F.col("p.game.gamePk").alias("game_id"),
                       *[F.get_json_object("p.stat", f"$.{path}").try_cast("double").alias(n) for n, path in fields.items()],
                       F.col("p.stat").alias("raw"))


def flatten_game_logs(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Regular-season game-log rows."""
    rows = _splits(docs).filter((F.col("type") == "gameLog") & (F.col("p.gameType") == "R"))
    return rows.select(F.col("p.player.id").alias("member"), F.col("p.game.gamePk").alias("game_id"), F.col("p.team.id").alias("team"),
                       *[F.get_json_object("p.stat", f"$.{path}").try_cast("double").alias(n) for n, path in fields.items()])


def flatten_standings(docs: DataFrame) -> DataFrame:
    r = parse(docs, STANDINGS).select(F.explode("j.records").alias("r")).select("r.division", F.explode("r.teamRecords").alias("t"))
    return r.select("division", F.col("t.team.id").alias("entity"), F.col("t.team.name").alias("name"), "t.wins", "t.losses",
                    F.try_divide("t.wins", F.col("t.wins") + F.col("t.losses")).alias("win_pct"),
                    (F.col("t.runsScored") - F.col("t.runsAllowed")).alias("differential"))


def _plays_and_external(play: str) -> tuple[Column, Column]:
    """The plays of a parsed summary in document order, and external probabilities by play id."""
    nothing = F.array().cast(f"array<{play}>")

    def drives(which: str) -> Column:
        return F.coalesce(F.flatten(F.transform(F.col(f"drives.{which}"), lambda d: F.coalesce(d["plays"], nothing))), nothing)

    plays = F.when(F.size(F.coalesce("plays", nothing)) > 0, F.col("plays")).otherwise(F.concat(drives("previous"), drives("current")))
    external = F.map_from_entries(F.transform(F.coalesce("winprobability", F.array().cast("array<struct<playId string, homeWinPercentage double>>")),
                                              lambda w: F.struct(w["playId"], w["homeWinPercentage"])))
    return plays, external


def flatten_plays(docs: DataFrame) -> DataFrame:
    """Plays in document order: the top-level list, else the drives' lists; with the external probability."""
    plays, external = _plays_and_external(PLAY)
    rows = parse(docs, SUMMARY).select("j.*").select(F.col("id").alias("game_id"), external.alias("wp"), F.posexplode(plays).alias("ord", "p"))
    return rows.select("game_id", "ord", F.col("p.id").alias("play_id"), F.col("p.period.number").alias("period"),
                       F.col("p.clock.displayValue").alias("clock"), F.col("p.homeScore").alias("home_score"),
                       F.col("p.awayScore").alias("away_score"), F.try_element_at("wp", F.col("p.id")).alias("external_wp"))


def situation_snapshots(docs: DataFrame, league: str = "nfl") -> DataFrame:
    """Labelled states with possession, down, distance and field position, one row per usable play.

    A play without a period or a score is skipped, and not counted in ``play_index``. Documents without both final scores, or
    with a tied one, give nothing. Possession compares the play's team id with the home side's; unknown stays NULL.
    """
    schema = (SUMMARY.replace(PLAY, SITUATION) + ", header struct<competitions array<struct<competitors array<struct<homeAway string, id string, "
              "score string, team struct<id string>>>>>>")
    plays, external = _plays_and_external(SITUATION)
    j = parse(docs, schema).select("j.*")
    sides = F.try_element_at("header.competitions", F.lit(1))["competitors"]
    home, away = _side(sides, "home"), _side(sides, "away")
    usable = F.filter(plays, lambda p: p["period"]["number"].isNotNull() & p["homeScore"].isNotNull() & p["awayScore"].isNotNull())
    rows = j.select(F.col("id").alias("game_id"), F.coalesce(home["team"]["id"], home["id"]).alias("home_id"), as_int(home["score"]).alias("hf"),
                    as_int(away["score"]).alias("af"), external.alias("wp"), F.posexplode(usable).alias("play_index", "p")).filter("hf <> af")
    secs = clock_seconds(F.col("p.clock.displayValue"))
    own = F.col("p.start.team.id")
    return rows.select(
        "game_id", "play_index", F.col("p.id").alias("play_id"), as_int("p.sequenceNumber").alias("sequence_number"),
        F.col("p.period.number").alias("period"), secs.alias("clock_seconds"), frac_remaining_clock(league, F.col("p.period.number"), secs).alias("frac"),
        F.col("p.homeScore").alias("home_score"), F.col("p.awayScore").alias("away_score"),
        (F.col("p.homeScore") - F.col("p.awayScore")).alias("margin"), (F.col("hf") > F.col("af")).cast("int").alias("home_won"),
        F.try_element_at("wp", F.col("p.id")).alias("external_wp"), (own == F.col("home_id")).cast("int").alias("offense_is_home"),
        own.alias("offense_team_id"), "p.start.down", "p.start.distance", F.col("p.start.yardLine").alias("yard_line"),
        F.col("p.start.yardsToEndzone").alias("yards_to_endzone"), F.coalesce("p.isTurnover", F.lit(False)).cast("int").alias("is_turnover"),
        F.col("p.type.text").alias("play_type"), F.coalesce("p.start.downDistanceText", "p.end.downDistanceText").alias("down_distance_text"))


def pivot_box(long: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """Long key/value box rows to one column per statistic."""
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col("stat") == s, F.col("value")), ignorenulls=True).alias(s) for s in stats])
