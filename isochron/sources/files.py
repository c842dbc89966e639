"""File sources and sinks: nested game JSON, Parquet by partition, CSV, incremental writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions.scalars import clock_to_seconds, normalize_type

GAME = """id long, gameDate string, gameType int, homeTeam struct<id:long,abbrev:string>, awayTeam struct<id:long,abbrev:string>,
plays array<struct<eventId:long,typeDescKey:string,periodDescriptor:struct<number:int,periodType:string>,timeInPeriod:string,
details:struct<xCoord:double,yCoord:double,zoneCode:string,eventOwnerTeamId:long,shotType:string,scoringPlayerId:long,shootingPlayerId:long,assist1PlayerId:long,assist2PlayerId:long,
winningPlayerId:long,losingPlayerId:long,hittingPlayerId:long,hitteePlayerId:long,blockingPlayerId:long,committedByPlayerId:long,drawnByPlayerId:long,playerId:long>>>"""

SHIFT = "data array<struct<gameId:long,playerId:long,teamId:long,period:int,startTime:string,endTime:string,duration:string,shiftNumber:int,typeCode:int,firstName:string,lastName:string>>"

_PERSON = "struct<playerId:long,toi:string,plusMinus:int,position:string,name:struct<default:string>>"
_ROSTER = f"struct<forwards:array<{_PERSON}>,defense:array<{_PERSON}>,goalies:array<{_PERSON}>>"
BOXSCORE = f"id long, gameDate string, gameType int, homeTeam struct<id:long>, awayTeam struct<id:long>, playerByGameStats struct<homeTeam:{_ROSTER},awayTeam:{_ROSTER}>"


def scan_events_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A typed row for each play with an id; roles by event type."""
    p = F.col("p")
    d = p.details
    raw = spark.read.schema(GAME).json(paths, multiLine=True).select("id", "homeTeam", F.explode("plays").alias("p")).filter(p.eventId.isNotNull())
    return raw.select(
        F.col("id").alias("game_id"), F.col("homeTeam.id").alias("home_team_id"), p.eventId.alias("event_id"), p.periodDescriptor.number.alias("period"), clock_to_seconds(p.timeInPeriod).alias("period_seconds"),
        normalize_type(p.typeDescKey).alias("event_type"), d.eventOwnerTeamId.alias("event_team_id"), d.xCoord.alias("x_coord"), d.yCoord.alias("y_coord"), d.zoneCode.alias("zone_code"), d.shotType.alias("shot_type"), *roles(d),
    )


def roles(d) -> list:
    """The first, second and third player of a play: only one field of each list is filled, by the play's type."""
    first = F.coalesce(d.scoringPlayerId, d.shootingPlayerId, d.winningPlayerId, d.hittingPlayerId, d.committedByPlayerId, d.playerId, d.blockingPlayerId)
    second = F.coalesce(d.assist1PlayerId, d.losingPlayerId, d.hitteePlayerId, d.drawnByPlayerId, F.when(d.shootingPlayerId.isNotNull(), d.blockingPlayerId))
    return [first.alias("player_1_id"), second.alias("player_2_id"), d.assist2PlayerId.alias("player_3_id")]


def scan_shifts_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row for each shift that has all of its four keys."""
    s = F.col("s")
    raw = spark.read.schema(SHIFT).json(paths, multiLine=True).select(F.explode("data").alias("s"))
    raw = raw.filter(s.gameId.isNotNull() & s.playerId.isNotNull() & s.teamId.isNotNull() & s.period.isNotNull())
    return raw.select(s.gameId.alias("game_id"), s.playerId.alias("player_id"), s.teamId.alias("team_id"), s.period.alias("period"), clock_to_seconds(s.startTime).alias("start_seconds"), clock_to_seconds(s.endTime).alias("end_seconds"), clock_to_seconds(s.duration).alias("duration"), s.shiftNumber.alias("shift_number"), s.typeCode.alias("type_code"))


def scan_boxscore(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row for each player of both rosters, with the game's date and type."""
    raw = spark.read.schema(BOXSCORE).json(paths, multiLine=True)

    def members(side: str, group: str):
        return F.transform(F.col(f"playerByGameStats.{side}.{group}"), lambda x: F.struct(F.col(f"{side}.id").alias("team_id"), F.lit(group).alias("roster"), x.alias("p")))

    groups = [members(side, group) for side in ("homeTeam", "awayTeam") for group in ("forwards", "defense", "goalies")]
    empty = F.array().cast("array<struct<team_id:bigint,roster:string,p:" + _PERSON + ">>")
    rows = raw.select(F.col("id").alias("game_id"), F.to_date("gameDate").alias("game_date"), F.col("gameType").alias("game_type"), F.explode(F.concat(*[F.coalesce(g, empty) for g in groups])).alias("r"))
    return rows.select("game_id", "game_date", "game_type", "r.team_id", "r.roster", F.col("r.p.playerId").alias("player_id"), clock_to_seconds(F.col("r.p.toi")).alias("toi_seconds"), F.col("r.p.plusMinus").alias("plus_minus"))


def scan_partitioned(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """Parquet with columns taken from each file's path by pattern (the first group)."""
    df = spark.read.parquet(path)
    return df.withColumns({name: F.regexp_extract(F.col("_metadata.file_path"), pattern, 1) for name, pattern in patterns.items()})


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder for each key value, which replaces the one that was there, so a job that runs again repeats nothing; rows
    of one value go to few files."""
    replace_partition(df.repartition(*keys), path, keys)


def replace_partition(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrites only the partitions that df has."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
