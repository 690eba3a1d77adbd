"""Joins between features, metadata and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.operators.selection import drop_present, normalise_ids


def _suffixed(df: DataFrame, names: set[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in names})


def merge_features(metadata: DataFrame, features: DataFrame, key: str = "imdbID", group: str | None = None,
                   id_prefix: str | None = "tt", label_columns: Sequence[str] = ("votes", "rating")) -> DataFrame:
    """Inner join of metadata and text features. Labels come from the metadata; other name clashes get suffixes.

    The group column (the show) is kept for grouped folds.
    """
    text_side = drop_present(features, label_columns)
    if id_prefix is not None and dict(text_side.dtypes)[key] == "string":
        text_side = normalise_ids(text_side, key, id_prefix)
    if group is not None:
        text_side = drop_present(text_side, [group])
    clash = (set(metadata.columns) & set(text_side.columns)) - {key}
    return _suffixed(metadata, clash, "_imdb").join(_suffixed(text_side, clash, "_sub"), key, "inner")


def not_yet_done(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not in the output yet."""
    return rows.join(existing.select(key), key, "left_anti")


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def upsert_listing(metadata: DataFrame, listing: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Mark metadata rows that have a file: the flag becomes true and the path is set.

    Of several files for one key the last path wins. Files without a metadata row are ignored; rows without a file
    stay as they were.
    """
    one = listing.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(path).alias("_path"))
    return metadata.join(one, list(keys), "left").withColumns({
        "subtitles_exists": F.when(F.col("_path").isNotNull(), F.lit(True)).otherwise(F.col("subtitles_exists")),
        "subtitles_full_path": F.coalesce("_path", "subtitles_full_path"),
    }).drop("_path")


def lookup_ids(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of wanted ids to a table with unique ids, with a ``missing`` flag instead of an error.

    One id may be wanted by any share of the rows: its rows are dealt out over salts.
    """
    marked = table.withColumn("_found", F.lit(True))
    others = [c for c in wanted.columns if c != key]
    return skew.lookup(wanted, marked, [key], others or [key]).withColumn("missing", F.col("_found").isNull()).drop("_found")


def missing_worklist(episodes: DataFrame) -> DataFrame:
    """Episodes that still need subtitles: the flag is known, and it is false or the path is empty.

    A false flag is enough, whatever the path; a true flag without a known path is left alone.
    """
    return episodes.where(F.col("subtitles_exists").isNotNull() & (~F.col("subtitles_exists") | (F.col("subtitles_full_path") == "")))
