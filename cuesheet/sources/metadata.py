"""Season metadata: JSON objects keyed by episode number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import naming

EPISODE = ("struct<imdb_id:string,subtitles_exists:boolean,subtitles_full_path:string,rating:double,votes:bigint>")


def explode_json_map(df: DataFrame, column: str, value_type: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry of a JSON object; the other columns are repeated."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.from_json(column, f"map<string,{value_type}>")).alias(key, value))


def read_season_metadata(spark: SparkSession, base: str) -> DataFrame:
    """One row per episode of every season file: ``(show, season, episode, imdb_id, subtitles_exists, ...)``."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "S*_metadata.json")
        .text(base, wholetext=True).select(naming.decoded_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("json"))
        .where(naming.base_name(F.col("path")).rlike(naming.SEASON_METADATA_NAME))
    )
    season = F.regexp_extract("path", r"/S(\d{1,2})_metadata\.json$", 1).cast("int")
    show = F.nullif(F.regexp_extract("path", r"/([^/]+)/Metadata/", 1), F.lit(""))
    named = files.select(show.alias("show"), season.alias("season"), "json")
    return explode_json_map(named, "json", EPISODE, "episode", "e").select(
        "show", "season", F.col("episode").try_cast("int").alias("episode"), "e.*")


def to_season_json(episodes: DataFrame) -> DataFrame:
    """Back to one JSON object per show and season. A season holds at most the episodes of its own file."""
    entry: Column = F.struct(F.col("episode").cast("string").alias("key"), F.struct(
        "imdb_id", "subtitles_exists", "subtitles_full_path", "rating", "votes").alias("value"))
    return episodes.groupBy("show", "season").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("json"))
