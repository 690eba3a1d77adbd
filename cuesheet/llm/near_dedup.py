"""Near copies by HyperMinHash.

The shingle hashes of a text fall into 128 buckets by their upper bits; of the least hash in each bucket a register keeps
the number of leading zeros and ten more bits. An empty bucket borrows another's register in an order that only depends
on the bucket. Texts whose registers agree in a whole band become candidates; candidates are gathered in clusters, and
inside a cluster the full shingle sets are compared.

Equal sets are one node from the start, so a group of copies of any size is one row. A cluster of bounded size is compared
in one task. In a larger one the pairs that share a band with the least node of that band are estimated from their
registers and verified first, which ties a tight group together in proportion to its size. What is still apart may be
linked all the same, so nodes of different parts meet on rare shingles: of two linked sets, ordered by how many sets of
large clusters hold a shingle, the first quarters always have one in common. A passage that many documents share is among
the last of that order and brings nobody together. The counts that order needs are one array of slots, so that only the
first quarters become rows. Nodes that met are compared block by block. Nothing but true links is emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.components import components
from cuesheet.llm.shingles import shingle_sets
from cuesheet.operators import skew
from cuesheet.session import materialise

BUCKETS, BUCKET_BITS, MANTISSA = 128, 7, 10
#: A pair with similarity 0.75 shares none of 42 bands of 3 registers with chance (1 - 0.75^3)^42 = 1e-10.
BAND_ROWS = 3
BANDS = BUCKETS // BAND_ROWS
SHINGLE = 5
LINK = (3, 4)  # intersection * 4 >= union * 3
CLUSTER_ROWS, CLUSTER_SHINGLES = 512, 1 << 19
ENTRIES_PER_SALT = 1000
#: Shingles are counted by their lowest bits, four slots to a shingle up to 2^22 (8 MB, sent to every task).
COUNT_BITS, COUNT_CHUNKS, COUNT_MOST = (16, 22), 256, 65_535
_BORROW = np.stack([np.random.default_rng(b).permutation(BUCKETS) for b in range(BUCKETS)])
_BORDERS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted, non-empty set of hashes: leading zeros above, mantissa below."""
    first = np.searchsorted(hashes, _BORDERS)
    filled = np.append(first[1:], len(hashes)) > first
    rest = hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(BUCKET_BITS)
    top = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits: the exponent is exact
    exponent = np.frexp(top)[1]
    zeros = np.clip(53 - exponent, 0, 53).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    value = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not filled.all():
        order = filled[_BORROW].argmax(1)
        value = value[_BORROW[np.arange(BUCKETS), order]]
    return value


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from register rows, corrected for registers that agree by chance."""
    chance = 0.1699 / (1 << MANTISSA)
    return np.maximum(0.0, ((a == b).mean(-1) - chance) / (1 - chance))


def least_estimate(n: np.ndarray) -> np.ndarray:
    """What the estimate of a link at 3/4 stays above but for a chance of 1e-9, where the smaller set has ``n`` shingles.

    Six standard deviations of a mean over the buckets that n hashes fill on their own: 0.45 from 128 shingles on, and
    nothing is ruled out below 17.
    """
    return 0.75 - 6 * np.sqrt(0.1875 / (0.6 * np.minimum(n, BUCKETS)))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, digest, registers)``; digest and registers are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def band_keys(column: str = "registers") -> Column:
    width = 2 * BAND_ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring(column, i * width + 1, width)) for i in range(BANDS)])


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """``(u, v, bands)``: every node that shares bands with others, the least node of such a band, and in how many it is that."""
    members = nodes.select("node", F.explode(band_keys()).alias("key"))
    hubs = materialise(members.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    met = skew.salted_lookup(members, hubs.select("key", "hub"), ["key"], hubs.select("key", "n"), "n", ["node"])
    return materialise(met.where(F.col("node") != F.col("hub")).groupBy(F.col("node").alias("u"), F.col("hub").alias("v"))
                       .agg(F.count(F.lit(1)).alias("bands")))


def intersections(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the hashes that occur twice, some columns at a time."""
    both = rows + others
    hashes = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    term = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
    shared = np.bincount(term)[term] > 1
    term, owner = term[shared], owner[shared]
    common = np.zeros((len(rows), len(others)), np.float32)
    if len(term):
        term = np.cumsum(np.concatenate([[True], term[1:] != term[:-1]])) - 1
        for a in range(0, int(term[-1]) + 1, 4096):
            lo, hi = np.searchsorted(term, [a, a + 4096])
            matrix = np.zeros((len(both), 4096), np.float32)
            matrix[owner[lo:hi], term[lo:hi] - a] = 1
            common += matrix[:len(rows)] @ matrix[len(rows):].T
    return np.rint(common).astype(np.int64)


def linked_pairs(rows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs whose full sets reach the similarity. Only rows that have a likely partner are compared in full."""
    size, marks = np.array([len(s) for s in rows]), np.stack([registers(s) for s in rows])
    likely = np.stack([estimate(r[None, :], marks) for r in marks]) >= least_estimate(np.minimum.outer(size, size))
    likely &= np.minimum.outer(size, size) * LINK[1] >= np.maximum.outer(size, size) * LINK[0]
    np.fill_diagonal(likely, False)
    at = np.flatnonzero(likely.any(0))
    if not len(at):
        return []
    common, n = intersections([rows[i] for i in at], [rows[i] for i in at]), size[at]
    x, y = np.nonzero(np.triu(common * LINK[1] >= (n[:, None] + n[None, :] - common) * LINK[0], 1))
    return list(zip(at[x].tolist(), at[y].tolist(), strict=True))


def _spanning(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join two parts: links beyond those do not change any component."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _links_in_one_task(members: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that span the true components of clusters of bounded size."""
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        pairs = _spanning(linked_pairs([np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]), len(nodes))
        return pa.table({"u": pa.array(nodes[[a for a, _ in pairs]], pa.int64()), "v": pa.array(nodes[[b for _, b in pairs]], pa.int64())})

    # comparing is more work than the few bytes tell: as many tasks as any shuffle has, not as few as the bytes would fill
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("cluster", "node", "set").repartition(tasks, "cluster").groupBy("cluster").applyInArrow(run, "u bigint, v bigint")


def _likely(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """Those ``(u, v)`` pairs of nodes of large clusters that lengths and registers do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ru", "rv"))
            n, m = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            yield batch.select(["u", "v"]).filter(pa.array(estimate(a, b) >= least_estimate(np.minimum(n, m))))

    def side(n: str) -> DataFrame:
        return large.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("registers").alias(f"r{n}")).hint("merge")

    fit = F.least("nu", "nv") * LINK[1] >= F.greatest("nu", "nv") * LINK[0]
    met = pairs.join(side("u"), "u").join(side("v"), "v").where(fit)
    return met.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those ``(u, v)`` pairs whose full sets are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("su"), batch.column("sv"), strict=True):
                a, b = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(common * LINK[1] >= (len(a) + len(b) - common) * LINK[0])
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")).hint("merge"), "u") \
        .join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")).hint("merge"), "v")
    return materialise(met.select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint"))


def shingle_counts(sets: DataFrame, slots: int) -> np.ndarray:
    """How many of the sets hold a shingle of each slot, a shingle's slot being its lowest bits; 65,535 stands for more.

    Every task adds its sets up in one array of ``slots``, a power of two; the arrays are added chunk by chunk.
    """
    chunks = min(COUNT_CHUNKS, slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.uint32)
        for batch in batches:
            for b in batch.column("set"):
                np.add.at(held, np.frombuffer(b.as_py(), np.uint64) & np.uint64(slots - 1), 1)
        parts = np.minimum(held, COUNT_MOST, out=held).astype(np.uint16).reshape(chunks, -1)
        filled = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([parts[i].tobytes() for i in filled], pa.binary())], ["chunk", "held"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(slots // chunks, np.int64)
        for b in table.column("held"):
            total += np.frombuffer(b.as_py(), np.uint16)
        return pa.table({"chunk": table.column("chunk")[:1], "held": pa.array([np.minimum(total, COUNT_MOST).astype(np.uint16).tobytes()], pa.binary())})

    found = np.zeros((chunks, slots // chunks), np.uint16)
    for r in sets.select("set").mapInArrow(count, "chunk bigint, held binary").groupBy("chunk").applyInArrow(add, "chunk bigint, held binary").collect():
        found[r["chunk"]] = np.frombuffer(r["held"], np.uint16)
    return found.reshape(-1)


def leading_shingles(parts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(node, cluster, block, part, n, at, h)``: the first quarter of every set, without the shingles that no other set holds.

    The order is the count of a shingle's slot, then the shingle itself; ``at`` is its place in the order. Two sets linked
    at 3/4 have a shingle in common among the first n - ceil(3n/4) + 1 of each, whatever the order is: shingles that share
    a slot cost meetings, not links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ats, hs = [], []
                for b in part.column("set"):
                    s = np.frombuffer(b.as_py(), np.uint64)
                    held = counts[s & np.uint64(len(counts) - 1)]
                    first = np.lexsort((s, held))[:len(s) - -(-len(s) * LINK[0] // LINK[1]) + 1]
                    at = np.flatnonzero(held[first] > 1)
                    ats.append(at)
                    hs.append(s[first[at]])
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in ats]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("node", "cluster", "block", "part", "n_shingles")),
                                                  pa.array(np.concatenate(ats), pa.int64()), pa.array(np.concatenate(hs).view(np.int64))],
                                                 ["node", "cluster", "block", "part", "n", "at", "h"])

    return parts.select("node", "cluster", "block", "part", "n_shingles", "set").mapInArrow(
        run, "node bigint, cluster bigint, block bigint, part bigint, n bigint, at bigint, h bigint")


def rare_meetings(parts: DataFrame, counts: np.ndarray) -> DataFrame:
    """Pairs ``(cluster, a, b, u, v)`` of ``(node, cluster, block, part, n_shingles, set)`` in different parts of a cluster that may be linked,
    and their blocks.

    They share one of their leading shingles. No more of either set than what follows the first shared one can be shared,
    so a meeting far down the order is none. Of a shingle's nodes, those in its commonest part meet the others only.
    """
    keys = ["cluster", "h"]
    entries = materialise(leading_shingles(parts, counts))
    held = entries.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    shared = materialise(held.groupBy(*keys).agg(F.sum("n").alias("df"), F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
                         .where(F.col("parts") > 1).select(*keys, "df", "main"))
    met = materialise(skew.salted_lookup(entries, shared.select(*keys, "main"), keys, shared.select(*keys, "df"), "df", ["node"]))
    hot = skew.hot_keys(shared, keys, "df", ENTRIES_PER_SALT)
    left, right = met.where(F.col("part") != F.col("main")), met.drop("main")
    if hot is not None:
        left, right, keys = skew.add_salt(left, keys, hot, ["node"]), skew.replicate(right, keys, hot), [*keys, "_salt"]
    others = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("node", "block", "part", "n", "at")])
    least = (F.col("n") + F.col("_n")) * LINK[0]  # of what two linked sets share, times the sum of the link's two numbers
    fit = (F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) * sum(LINK) >= least) & (F.least("n", "_n") * LINK[1] >= F.greatest("n", "_n") * LINK[0])
    once = (F.col("part") != F.col("_part")) & ((F.col("_part") == F.col("main")) | (F.col("part") < F.col("_part")))
    pairs = left.join(others.hint("merge"), keys).where(once & fit)
    return materialise(pairs.select("cluster", F.col("block").alias("a"), F.col("_block").alias("b"), F.col("node").alias("u"), F.col("_node").alias("v")).distinct())


def _links_in_cells(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that span what ``(cluster, a, b, u, v)`` pairs connect.

    The nodes of two blocks that have a pair come together in one task, each once.
    """
    cell = F.struct("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("cluster")
    cells = pairs.select(cell, F.col("u").alias("node")).union(pairs.select(cell, F.col("v").alias("node"))).distinct()
    return _links_in_one_task(cells.join(sets.select("node", "set").hint("merge"), "node"))


def cluster_links(members: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that span the true components of ``(node, cluster, n_shingles, set)``, from candidate edges and registers."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles")) \
        .select("cluster", ((F.col("rows") > CLUSTER_ROWS) | (F.col("shingles") > CLUSTER_SHINGLES)).alias("large"),
                F.ceil(F.greatest(F.col("rows") * 2 / CLUSTER_ROWS, F.col("shingles") * 2 / CLUSTER_SHINGLES)).alias("blocks"))
    placed = materialise(skew.lookup(members, sizes, ["cluster"], ["node"]))
    inside = materialise(_links_in_one_task(placed.where(~F.col("large"))))
    large = placed.where("large").select("node", "cluster", "n_shingles", "set", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    if large.isEmpty():
        return inside
    marks = materialise(large.select("node", "n_shingles").join(nodes.select("node", "registers").hint("merge"), "node"))

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """Every node takes the least part among its own and its linked nodes', then that node's: a step towards components.

        Nodes of one part are connected, which is all that is needed here; connected parts with different names cost
        verifications, not links.
        """
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.join(parts.select(F.col("node").alias("v"), "part").hint("merge"), "v").select(F.col("u").alias("node"), "part")
        least = materialise(parts.union(near).groupBy("node").agg(F.min("part").alias("part")))
        jump = least.select(F.col("node").alias("part"), F.col("part").alias("next")).hint("merge")
        return materialise(least.join(jump, "part", "left").select("node", F.coalesce("next", "part").alias("part")))

    # the best edge of every node ties most of a tight group; of the other edges only those between parts are verified
    best = materialise(edges.groupBy("u").agg(F.max_by("v", F.struct("bands", "v")).alias("v")))
    links = _verified(_likely(best, marks), large)
    parts = joined(marks.select("node", F.col("node").alias("part")), links)
    others = edges.select("u", "v").join(best.hint("merge"), ["u", "v"], "left_anti")
    between = others.join(parts.select(F.col("node").alias("u"), F.col("part").alias("pu")).hint("merge"), "u") \
        .join(parts.select(F.col("node").alias("v"), F.col("part").alias("pv")).hint("merge"), "v").where(F.col("pu") != F.col("pv"))
    more = _verified(_likely(between.select("u", "v"), marks), large)
    # what is still apart meets on rare shingles
    total = large.agg(F.sum("n_shingles")).first()[0]
    counts = shingle_counts(large, 1 << min(max(int(4 * total).bit_length(), COUNT_BITS[0]), COUNT_BITS[1]))
    rest = rare_meetings(large.join(joined(parts, more).hint("merge"), "node"), counts)
    return inside.union(links).union(more).union(materialise(_links_in_cells(rest, large)))


def full_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(node, cluster, n_shingles, set)`` for ``wanted`` nodes ``(doc_id, digest, node, cluster)``, from their texts.

    The ids are broadcast behind a check of their number; beyond it the texts are joined by a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = shingle_sets(part.column("text"), size)
                own = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                rows = pa.RecordBatch.from_arrays([
                    part.column("node"), part.column("cluster"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "cluster", "n_shingles", "set"])
                same = [a.as_py() == b.as_py() for a, b in zip(own, part.column("digest"), strict=True)]
                yield rows.filter(pa.array(same, pa.bool_()))

    small = skew.is_small(wanted)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(wanted) if small else wanted.hint("merge"), F.expr("doc_id <=> id"))
    found = texts.select("node", "cluster", "digest", "text").mapInArrow(run, "node bigint, cluster bigint, n_shingles bigint, set binary")
    return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents``.

    Words are runs without ASCII white space, A to Z in lower case; a set holds the distinct runs of five words, or the
    whole text where it has fewer. Documents are linked at a Jaccard similarity of 0.75 or more, confirmed on the full
    sets (of 64-bit shingle hashes); a component is everything reachable, named by its smallest doc_id. A null or empty
    text has an empty set and is linked with nothing. Repeated rows have equal sets and are linked. A null doc_id is
    never the smallest unless there is no other; such a row is kept where it stands alone. Other columns are ignored.
    """
    rows = materialise(signatures(docs, size))
    nodes = materialise(
        rows.where(F.col("digest").isNotNull()).groupBy("digest", "n_shingles", "registers")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    edges = candidate_edges(nodes)
    clusters = materialise(components(edges.select("u", "v")).withColumnRenamed("component", "cluster"))
    wanted = materialise(nodes.join(clusters, "node").select(F.col("least").alias("id"), "digest", "node", "cluster"))
    members = full_sets(docs, wanted, size).dropDuplicates(["node"])
    found = components(cluster_links(members, edges, nodes))
    part = nodes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("part"))
    names = part.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = materialise(part.join(names, "part").select("digest", "component_id"))
    labelled = rows.where(F.col("digest").isNotNull()).join(labels.hint("merge"), "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unused(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns: one of each component, one of repeated rows.

    A null or empty text is linked with nothing and stays; rows of equal doc_id and text are one. No rows give no rows;
    columns of any name pass through. The ids that go are broadcast behind a check of their number, and joined by a
    shuffle beyond it.
    """
    gone, twice, text = (_unused(n, docs) for n in ("_gone", "_twice", "_text"))
    leaving = materialise(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct())
    table = F.broadcast(leaving) if skew.is_small(leaving) else leaving.hint("merge")
    kept = docs.join(table, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")
    repeated = materialise(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("doc_id").alias(twice)))
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(twice))
    single = kept.join(repeated, same, "left_anti")
    return single.union(kept.join(repeated, same, "left_semi").withColumn(text, F.coalesce("text", F.lit("")))
                        .dropDuplicates(["doc_id", text]).drop(text))
