"""Exact copies by content-defined chunks.

Each text is cut where a rolling hash of its last 32 bytes says so. A chunk moves once per task to the place where all
chunks of its digest are compared byte by byte; from then on its digest, with an ordinal where two chunks share one, is
a verified identifier. A document is its recipe, the ordered list of identifiers, and copies are found by comparing
recipes. Long documents themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.session import materialise, scratch_path

WINDOW = 32
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 512, 11, 16_384
ID_BYTES = 16
#: Bytes hashed at once: bounds a task's memory however long a text is.
SLICE = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: positions after which the hash of the last 32 bytes has its upper bits zero."""
    found = []
    for start in range(0, len(data), SLICE):
        lead = min(start, WINDOW - 1)
        h = GEAR[data[start - lead:start + SLICE]]
        width = 1
        while width < WINDOW:  # h covers ``width`` bytes, then twice as many
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h, width = wider, 2 * width
        found.append(np.flatnonzero(h[lead:] >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of ``start:end``. The least length exceeds the window, so only the chunk's own bytes decide."""
    ends, at = [], start
    while end - at > MIN_CHUNK:
        i = np.searchsorted(points, at + MIN_CHUNK)
        at = min(int(points[i]) if i < len(points) else end, at + MAX_CHUNK, end)
        ends.append(at)
    if at < end:
        ends.append(end)
    return ends


def recipes(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """``(doc_id, text_sha256, recipe, chunks)``: the digests of the chunks end to end, and the chunks themselves."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]]
            ends, points, raw = ends - ends[0], cut_points(data), memoryview(data.tobytes())
            whole, lists, pieces = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                borders = [a, *chunk_ends(points, a, b)]
                own = [raw[x:y] for x, y in zip(borders[:-1], borders[1:], strict=True)]
                whole.append(hashlib.sha256(raw[a:b]).hexdigest())
                lists.append(b"".join(hashlib.blake2b(c, digest_size=id_bytes).digest() for c in own))
                pieces.append([bytes(c) for c in own])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_sha256": whole, "recipe": pa.array(lists, pa.binary()),
                "chunks": pa.array(pieces, pa.list_(pa.binary()))})

    slim = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(cut, "doc_id bigint, text_sha256 string, recipe binary, chunks array<binary>")


def verified(table: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` with recipes that are equal for equal texts and for no others.

    All chunks of one digest are compared. Where two differ, each gets an ordinal, and the recipes that hold such a
    digest are rewritten with digest and ordinal; the others stay as they are, so that the two kinds cannot be equal.
    """
    ids = F.transform(F.sequence(F.lit(0), F.size("chunks") - 1), lambda i: F.substring("recipe", i * id_bytes + 1, id_bytes))
    filled = table.where(F.size("chunks") > 0)
    distinct = filled.select(F.explode(F.arrays_zip(ids.alias("id"), "chunks")).alias("c")) \
        .select(F.col("c.id").alias("id"), F.col("c.chunks").alias("chunk")).distinct()
    clashing = materialise(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id"))
    plain = table.select("doc_id", "text_sha256", "recipe")
    if clashing.isEmpty():
        return plain
    rows = materialise(filled.withColumn("_row", F.monotonically_increasing_id()))
    placed = rows.select("_row", F.posexplode(F.arrays_zip(ids.alias("id"), "chunks")).alias("at", "c")) \
        .select("_row", "at", F.col("c.id").alias("id"), F.col("c.chunks").alias("chunk"))
    variants = distinct.join(clashing, "id").withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    named = placed.join(variants, ["id", "chunk"], "left").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("at", "id", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("l"))
    text = F.transform("l", lambda c: F.concat(F.hex(c["id"]), F.lit(":"), c["ordinal"].cast("string")))
    rewritten = rows.select("_row", "doc_id", "text_sha256").join(named, "_row").select(
        "doc_id", "text_sha256", F.concat(F.lit("v"), F.array_join(text, ",")).cast("binary").alias("recipe"))
    return rewritten.union(plain.where(F.length("recipe") == 0))


def exact_duplicates(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``documents``.

    Texts are equal when identical after lower-casing A to Z; a null text is empty. The row with the largest doc_id
    stays; of repeated rows with that doc_id just one does. A null doc_id ranks lowest. No rows give no rows, columns
    other than doc_id and text are ignored. Recipes are grouped with partial sums per task, and a hot recipe's rows,
    a digest and two numbers each, are dealt out over the tasks by the adaptive join.
    """
    path = scratch_path(docs.sparkSession, "chunks")
    cut = recipes(docs, id_bytes)
    cut.write.option("compression", "zstd").parquet(path)
    table = docs.sparkSession.read.schema(cut.schema).parquet(path)
    rows = materialise(verified(table, id_bytes).withColumn("_tie", F.monotonically_increasing_id()))
    # cut off, so that the join shuffles both sides itself and the adaptive join may split a hot recipe
    groups = materialise(rows.groupBy("recipe").agg(
        F.max(F.struct("doc_id", "_tie")).alias("_last"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups.hint("merge"), "recipe").select(
        "doc_id", F.col("_last.doc_id").alias("keep_id"), "group_size", (F.col("_tie") == F.col("_last._tie")).alias("kept"),
        "text_sha256")


def exact_sql(documents: str = "documents") -> str:
    """The same in DuckDB for a table whose doc_ids are distinct."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS x FROM {documents}),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, x FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g"""
