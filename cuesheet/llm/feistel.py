"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Rows are numbered 0..n-1 along a total order. A Feistel network permutes ``a * b >= n`` numbers, cycle walking takes a
number that leaves 0..n-1 through the network again until it is back, and position p goes to shard ``p mod shards``,
slot ``p div shards``. Both directions are formulas in n and the key: nothing is looked up, and a reader can compute
which row any slot holds.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.vectors import let
from cuesheet.session import materialise

ROUNDS = 6
#: At most ``a - 1 < sqrt(n)`` numbers lie outside 0..n-1, so a walk of this length fails with chance below n * n^(-WALK/2);
#: for n up to WALK squared it cannot fail. A walk that does fail raises an error.
WALK = 24
_INDEX_BITS = 33  # monotonically_increasing_id: partition number above, index in the partition below


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number the rows 0..n-1 along ``order`` and return them with n. Nulls come first; equal rows are numbered in any order.

    A range shuffle with a last tie-breaking key splits a value that many rows share. Only one count per partition is
    gathered, and those are summed in a table of as many rows as there are partitions.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = materialise(
        tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part, index = F.shiftright("_at", _INDEX_BITS), F.col("_at").bitwiseAND((1 << _INDEX_BITS) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + index).drop("_at", "_part", "_offset")), total


def _sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _draw(key: str, step: Column, value: Column) -> Column:
    """60 bits of a digest of key, round and half."""
    text = F.concat(F.lit(f"{key}:"), step.cast("string"), F.lit(":"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _network(x: Column, a: int, b: int, key: str, sign: int) -> Column:
    """One pass: the halves take turns in adding a digest of the other. ``sign`` -1 undoes the pass."""
    def turn(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(i % 2 == 0, F.struct(F.pmod(left + sign * (_draw(key, i, right) % a), F.lit(a)).alias("l"), right.alias("r"))) \
            .otherwise(F.struct(left.alias("l"), F.pmod(right + sign * (_draw(key, i, left) % b), F.lit(b)).alias("r")))

    rounds = range(ROUNDS) if sign > 0 else reversed(range(ROUNDS))
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: int, key: str, inverse: bool = False) -> Column:
    """The place of number ``x`` in the keyed permutation of 0..n-1, or with ``inverse`` the number at place ``x``."""
    a, b = _sides(n)
    sign = -1 if inverse else 1
    outside = F.lit(n)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), x.cast("bigint"),
        lambda at, i: F.when((i == 1) | (at >= outside), _network(at, a, b, key, sign)).otherwise(at))
    return let(walk, lambda at: F.when(at < outside, at).otherwise(F.raise_error(F.lit("the walk is too short")).cast("bigint")))


def shard_rows(df: DataFrame, order: list[Column], shards: int = 8, key: str = "shuffle") -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``. Shards differ by one row at most; slots run from 0 without gaps.

    The result depends on the rows, their order, ``shards`` and ``key`` alone, not on partitions or files. No rows give
    no rows. Columns of those three names are replaced.
    """
    numbered, n = row_numbers(df.drop("row_number", "shard", "slot"), order)
    return (numbered.withColumn("_place", permuted(F.col("row_number"), n, key))
            .withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor(F.col("_place") / shards).cast("bigint")).drop("_place"))


def row_at(shard: Column, slot: Column, n: int, shards: int = 8, key: str = "shuffle") -> Column:
    """The row number that a slot holds."""
    return permuted(slot.cast("bigint") * shards + shard, n, key, inverse=True)


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "shuffle") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``documents``.

    Row numbers follow doc_id, then the text's checksum and size, nulls first. The law is ``rows``: counts at most one
    apart. Size is the text's UTF-8 bytes plus 1; a null text counts as empty and has the checksum 0. ``grown_shard``
    belongs to another law and is null. Equal texts are spread like any rows, repeated rows each get a slot of their own.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def shard_sql(documents: str = "documents", shards: int = 8, key: str = "shuffle") -> str:
    """The same in DuckDB: halves in nested selects, the walk as a recursive table, the checksum by half bytes."""
    def network(source: str) -> str:
        query = f"SELECT rn, x // b AS l, x % b AS r, a, b, n FROM {source}"
        for i in range(ROUNDS):
            draw = f"('0x' || substr(md5('{key}:{i}:' || {'r' if i % 2 == 0 else 'l'}), 1, 15))::BIGINT"
            halves = f"(l + {draw} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {draw} % b) % b AS r"
            query = f"SELECT rn, {halves}, a, b, n FROM ({query})"
        return f"SELECT rn, (l * b + r)::BIGINT AS x, a, b, n FROM ({query})"

    low = "xor(t16[(xor(c, d) & 15) + 1], c >> 4)"
    byte = f"xor(t16[(xor({low}, d >> 4) & 15) + 1], {low} >> 4)"
    table = list(range(16))
    for _ in range(4):
        table = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
         {table}::BIGINT[] AS t16 FROM {documents}),
sums AS (
  SELECT doc_id, (len(bytes) + 1)::BIGINT AS size,
         xor(list_reduce(bytes, lambda c, d: {byte}, 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM bytes),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn, count(*) OVER () AS n FROM sums),
sides AS (SELECT rn, rn AS x, n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM numbered),
started AS (SELECT rn, x, a, greatest(1, (n + a - 1) // a)::BIGINT AS b, n FROM sides),
walk AS ({network("started")} UNION ALL {network("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, (x // {shards})::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM numbered JOIN (SELECT rn, x FROM walk WHERE x < n) USING (rn)"""
