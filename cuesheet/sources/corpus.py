"""Subtitle corpora: file discovery, SRT and ASS parsing, archives.

Parsing is done with built-in expressions, one file per row; nothing but archive expansion needs Python.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import naming

_CLOCK = r"\s*(\d+)[:.,](\d+)[:.,](\d+)[:.,](\d+)"
SRT_TIMES = _CLOCK + r"\s*-->" + _CLOCK
ASS_TIME = r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*:\s*(\d{1,2})\s*[.,]\s*(\d{1,3})"


def read_files(spark: SparkSession, base: str | Sequence[str], glob: str = "*.{srt,ass}", encoding: str = "UTF-8") -> DataFrame:
    """One row per file below a folder: ``(path, name, show, season, episode, content)``.

    The show is the folder above ``Subtitles``; season and episode come from the file name, the season otherwise from
    its folder.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
        .select("path", F.decode("content", encoding).alias("content"))
    )
    return with_path_parts(raw.withColumn("path", naming.decoded_path(F.col("path"))))


def with_path_parts(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    folder = F.nullif(F.regexp_extract("path", r"/S(\d{1,2})/[^/]*$", 1), F.lit("")).cast("int")
    return files.select(
        "path", name.alias("name"),
        F.nullif(F.regexp_extract("path", r"/([^/]+)/Subtitles/", 1), F.lit("")).alias("show"),
        F.coalesce(naming.season_number(name), folder).alias("season"),
        naming.episode_number(name).alias("episode"),
        *[c for c in files.columns if c != "path"],
    )


def file_format(path: Column) -> Column:
    """``ass`` or ``srt`` by the ending of the path, null for any other type."""
    return F.when(path.endswith(".ass"), F.lit("ass")).when(path.endswith(".srt"), F.lit("srt"))


def _ms(at: Column, pattern: str, first: int, fraction: Callable[[Column], Column]) -> Column:
    h, m, s, f = (F.regexp_extract(at, pattern, first + i) for i in range(4))
    return (h.cast("bigint") * 3600 + m.cast("bigint") * 60 + s.cast("bigint")) * 1000 + fraction(f).cast("bigint")


def _unified(content: Column) -> Column:
    """Line feeds only, no byte-order mark."""
    return F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), r"\r\n?", "\n")


def srt_cues(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cues of SRT files: ``(doc_id, pos, start_ms, end_ms, text)`` in file order.

    Blank lines end a block. A block is an optional number line, a time line, and text; any other block is skipped.
    """
    blocks = files.select(F.col("path").alias("doc_id"), *keep, F.posexplode(
        F.split(_unified(F.col("content")), r"\n(?:[ \t]*\n)+")).alias("pos", "raw"))
    block = F.regexp_replace("raw", r"^(?:[ \t]*\n)+", "")
    timed = blocks.withColumn("block", F.regexp_replace(block, r"^(?![^\n]*-->)[^\n]*\n", ""))
    as_is = lambda f: f
    return timed.where(F.col("block").rlike("^" + SRT_TIMES)).select(
        "doc_id", *keep, F.col("pos").cast("bigint").alias("pos"),
        _ms(F.col("block"), SRT_TIMES, 1, as_is).alias("start_ms"), _ms(F.col("block"), SRT_TIMES, 5, as_is).alias("end_ms"),
        F.regexp_replace("block", r"^[^\n]*(?:\n|$)", "").alias("text"))


def ass_cues(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events of ASS files in file order; the text is the tenth field, may hold commas, and is left as it is."""
    rows = files.select(F.col("path").alias("doc_id"), *keep, F.posexplode(
        F.split(_unified(F.col("content")), "\n")).alias("pos", "row"))
    fields = F.split(F.regexp_replace("row", r"^(?:Dialogue|Comment):\s*", ""), ",", 10)
    padded = lambda f: F.rpad(f, 3, "0")
    return (
        rows.where(F.col("row").rlike(r"^(?:Dialogue|Comment):")).withColumn("f", fields)
        .where((F.size("f") == 10) & F.col("f")[1].rlike(ASS_TIME) & F.col("f")[2].rlike(ASS_TIME))
        .select("doc_id", *keep, F.col("pos").cast("bigint").alias("pos"),
                _ms(F.col("f")[1], ASS_TIME, 1, padded).alias("start_ms"),
                _ms(F.col("f")[2], ASS_TIME, 1, padded).alias("end_ms"), F.col("f")[9].alias("text"))
    )


def read_cues(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cues of every file, by its format."""
    kind = file_format(F.col("path"))
    return srt_cues(files.where(kind == "srt"), keep).unionByName(ass_cues(files.where(kind == "ass"), keep))


def rejects(files: DataFrame, cues: DataFrame) -> DataFrame:
    """Files that give no features, with the reason."""
    typed = files.select(F.col("path").alias("doc_id"), file_format(F.col("path")).alias("kind"))
    wrong = typed.where(F.col("kind").isNull()).select("doc_id", F.lit("file type is neither .srt nor .ass").alias("reason"))
    empty = typed.where(F.col("kind").isNotNull()).join(cues.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit("no cue could be parsed").alias("reason"))
    return wrong.unionByName(empty)


UNREADABLE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)


def _members(batches: Iterator[pd.DataFrame], most: int | None) -> Iterator[pd.DataFrame]:
    """A table per archive, so that a task holds the members of one at a time."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [m for m in z.infolist() if not m.is_dir()][:most]
                    rows = [(path, i, m.filename, z.read(m), None) for i, m in enumerate(found)]
                    rows = rows or [(path, None, None, None, "archive is empty")]
            except UNREADABLE as e:
                rows = [(path, None, None, None, f"archive cannot be read: {e}")]
            yield pd.DataFrame(rows, columns=["path", "position", "member", "content", "reason"])


def expand_archives(spark: SparkSession, base: str | Sequence[str], glob: str = "*.zip", first_only: bool = False) -> DataFrame:
    """Members of every archive below a folder, or of the given archives: ``(path, position, member, content, reason)``.

    An unreadable or empty archive is one row with a reason. Members stay in the table; nothing is written beside the
    archives, so nothing can be overwritten. With ``first_only`` just the first member is read.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    most = 1 if first_only else None
    return archives.select(naming.decoded_path(F.col("path")).alias("path"), "content").mapInPandas(
        lambda batches: _members(batches, most), "path string, position int, member string, content binary, reason string")


def list_files(spark: SparkSession, base: str, glob: str = "*.{srt,ass,zip}") -> DataFrame:
    """``(path, key)`` of the files below a folder. No content is read: only the path is asked for."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    return listed.select("path", path_key(naming.decoded_path(F.col("path"))).alias("key"))


def path_key(path: Column) -> Column:
    """A path without scheme and host: equal for a listing and for metadata that names the file in another way."""
    return F.regexp_replace(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*", "/")


def first_members(members: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """The first member of each archive as a file row; its own name decides the format."""
    first = members.where(F.col("position") == 0)
    return with_path_parts(first.select(F.concat_ws("!/", "path", "member").alias("path"), F.col("path").alias("archive"),
                                        F.decode("content", encoding).alias("content")))
