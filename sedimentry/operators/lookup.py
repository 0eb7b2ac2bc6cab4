"""Nested documents to flat rows, with dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types that carry no play.
SKIPPED = ("period-start", "period-end", "game-end", "stoppage", "period-official", "game-scheduled", "delayed-game")

PLAY_SCHEMA = """
gameDate string, awayTeam struct<id: bigint, abbrev: string>, homeTeam struct<id: bigint, abbrev: string>,
rosterSpots array<struct<playerId: bigint, sweaterNumber: bigint, firstName: struct<default: string>, lastName: struct<default: string>>>,
plays array<struct<eventId: bigint, typeDescKey: string, timeInPeriod: string, periodDescriptor: struct<number: bigint>,
  details: struct<xCoord: double, yCoord: double, zoneCode: string, shotType: string, eventOwnerTeamId: bigint,
    shootingPlayerId: bigint, scoringPlayerId: bigint, assist1PlayerId: bigint, assist2PlayerId: bigint, committedByPlayerId: bigint,
    hittingPlayerId: bigint, hitteePlayerId: bigint, winningPlayerId: bigint, typeCode: string, duration: bigint>>>
"""


def look_up_roles(rows: DataFrame, people: DataFrame, key: str, name: str, roles: dict[str, str]) -> DataFrame:
    """rows with one name per role. roles: id column -> name column. Keys are made unique; id 0 and null match nothing.

    One look-up join per role, each of which Spark broadcasts while people is small; the rows themselves are never gathered again.
    """
    people = people.groupBy(F.col(key).cast("bigint").alias("__id")).agg(F.max(name).alias("__name"))
    for col, out in roles.items():
        own = people.where("__id <> 0").select(F.col("__id").alias(f"__{out}"), F.col("__name").alias(out))
        rows = rows.join(own, F.col(col).cast("bigint") == F.col(f"__{out}"), "left").drop(f"__{out}")
    return rows


def roster_map(spots: Column) -> Column:
    """Player id -> 'first last' from a roster array; the last entry of an id wins."""
    full = lambda s: F.concat_ws(" ", s["firstName"]["default"], s["lastName"]["default"])
    last = F.transform(spots, lambda s, i: F.struct(s["playerId"].alias("id"), full(s).alias("name"), i.alias("at")))
    unique = F.filter(last, lambda s: ~F.exists(last, lambda o: (o["id"] == s["id"]) & (o["at"] > s["at"])))
    return F.map_from_entries(F.transform(unique, lambda s: F.struct(s["id"], s["name"])))


def flatten_plays(games: DataFrame) -> DataFrame:
    """One row per play of the event types that carry one; columns that a type lacks are null."""
    d = F.col("p.details")
    kind = F.col("p.typeDescKey")
    shot = kind.isin("shot-on-goal", "missed-shot", "blocked-shot")
    who = lambda col: F.when(d[col] != 0, F.try_element_at("__names", d[col]))
    rows = games.withColumn("__names", roster_map(F.col("rosterSpots"))).select("*", F.explode("plays").alias("p"))
    rows = rows.where(~kind.isin(*SKIPPED))
    team = F.when(d["eventOwnerTeamId"] == F.col("awayTeam.id"), F.col("awayTeam.abbrev")).otherwise(F.col("homeTeam.abbrev"))
    return rows.select(
        F.col("gameDate").alias("game_date"),
        F.col("p.eventId").alias("event_id"),
        kind.alias("event_type"),
        F.col("p.periodDescriptor.number").alias("period"),
        F.when(shot | kind.isin("goal", "penalty", "hit", "faceoff"), team).alias("team"),
        F.when(shot, who("shootingPlayerId")).when(kind == "goal", who("scoringPlayerId")).when(kind == "penalty", who("committedByPlayerId"))
        .when(kind == "hit", who("hittingPlayerId")).when(kind == "faceoff", who("winningPlayerId")).alias("player"),
        F.when(kind == "goal", who("assist1PlayerId")).alias("assist_1"),
        F.when(kind == "goal", who("assist2PlayerId")).alias("assist_2"),
        F.when(kind == "hit", who("hitteePlayerId")).alias("target"),
        F.when(kind == "shot-on-goal", "SAVE").when(kind == "goal", "GOAL").when(shot, F.upper(kind)).alias("result"),
        F.when(shot | (kind == "goal"), d["shotType"]).alias("shot_type"),
        F.when(kind == "penalty", d["duration"]).alias("penalty_minutes"),
        F.when(d["xCoord"].isNotNull(), d["xCoord"]).alias("x"),
        F.when(d["xCoord"].isNotNull(), d["yCoord"]).alias("y"),
        F.when(d["xCoord"].isNotNull(), d["zoneCode"]).alias("zone"),
    )


def in_zones(value: Column, zones: list[tuple[float, float]]) -> Column:
    """Whether value lies in any closed interval: a range join with a literal side, without a join."""
    spans = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(z)).alias("z")) for a, z in zones])
    return F.exists(spans, lambda s: value.between(s["a"], s["z"]))


def game_id(season: Column, kind: Column, number: Column) -> Column:
    return F.format_string("%d%s%04d", season, kind, number)
