"""k-means, one model per document, all documents in one plan.

On dense vectors every round is one pass over all documents. On sparse term weights, documents up to a bound of entries
come together whole, many to a batch, and run all rounds in the task that holds them; larger ones run in rounds over a
table of (line, term) rows, joined with their centers by term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.vectors import as_double, squared_distance
from cuesheet.operators import skew, tfidf
from cuesheet.operators.collections import ENTRIES_PER_TASK, Batch, Collection, in_documents
from cuesheet.session import materialise

ROWS_PER_SALT = 250_000
#: Rounds go on until no label moves; this bound only stops a model that would never settle.
MAX_ROUNDS = 300


def _salted(points: DataFrame, rows_per_salt: int) -> tuple[DataFrame, DataFrame | None]:
    """Give the points of hot documents a salt once; every round reuses it."""
    counts = points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    hot = skew.hot_keys(counts, ["doc_id"], "_n", rows_per_salt)
    return (points.withColumn("_salt", F.lit(0)) if hot is None else skew.add_salt(points, ["doc_id"], hot, ["pos"])), hot


def _per_document(centroids: DataFrame, hot: DataFrame | None) -> DataFrame:
    """All centroids of a document in one row: at most k small vectors."""
    packed = centroids.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    return packed.withColumn("_salt", F.lit(0)) if hot is None else skew.replicate(packed, ["doc_id"], hot)


def _nearest(points: DataFrame, packed: DataFrame) -> DataFrame:
    """Nearest center; equal distances (9 decimals) go to the lower cluster number."""
    ranked = F.transform("centers", lambda c: F.struct(
        F.round(squared_distance(F.col("vector"), c["center"]), 9).alias("d"), c["cluster"].alias("cluster")))
    return points.join(packed, ["doc_id", "_salt"]).withColumn("cluster", F.array_min(ranked)["cluster"]).drop("centers")


def grouped_kmeans(vectors: DataFrame, k: int = 5, rounds: int = MAX_ROUNDS, until_stable: bool = True,
                   rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Lloyd's rounds for every document at once: ``(doc_id, pos, cluster)``.

    The first ``k`` distinct vectors by position are the first centers, so the result is deterministic. A cluster that
    loses all its lines disappears. Stops early when no label moves; each round is materialised, so the plan does not
    grow.
    """
    present = vectors.where(F.col("vector").isNotNull()).select("doc_id", "pos", as_double(F.col("vector")).alias("vector"))
    salted, hot = _salted(present, rows_per_salt)
    points = materialise(salted)
    first = Window.partitionBy("doc_id").orderBy("pos")
    centroids = (
        points.groupBy("doc_id", "vector").agg(F.min("pos").alias("pos"))
        .withColumn("cluster", F.row_number().over(first)).where(F.col("cluster") <= k)
        .select("doc_id", "cluster", F.col("vector").alias("center"))
    )
    labelled = materialise(_nearest(points, _per_document(centroids, hot)))
    for _ in range(rounds):
        centroids = labelled.groupBy("doc_id", "cluster").agg(
            vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("center"))
        renamed = labelled.withColumnRenamed("cluster", "_before")
        moved = materialise(_nearest(renamed, _per_document(centroids, hot)))
        settled = until_stable and moved.where(F.col("cluster") != F.col("_before")).isEmpty()
        labelled = moved.drop("_before")
        if settled:
            break
    return labelled.select("doc_id", "pos", "cluster")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_features(labels: DataFrame, n_clusters: int = 5) -> DataFrame:
    """``num_clusters`` and ``dominant_cluster_ratio``; documents with fewer lines than clusters get n and 1.0."""
    n = F.sum("size")
    return cluster_sizes(labels).groupBy("doc_id").agg(
        F.when(n < n_clusters, n).otherwise(F.count(F.lit(1))).cast("bigint").alias("num_clusters"),
        F.when(n < n_clusters, F.lit(1.0)).otherwise(F.max("size") / n).alias("dominant_cluster_ratio"))


def corpus_kmeans(vectors: DataFrame, k: int = 5, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """One model over the lines of all documents."""
    ready = vectors.where(F.col("vector").isNotNull()).select(
        "doc_id", "pos", array_to_vector(as_double(F.col("vector"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select("doc_id", "pos", "cluster")


# -- sparse term vectors --------------------------------------------------------------------------------------------

_BIAS = ""  # stands for "no term": its weight is 1 in every line, so one lookup also fetches the center's length


def _centers(members: DataFrame, k: int) -> DataFrame:
    """``(doc_id, term, c)`` with one value per cluster; the bias row holds -|center|²/2, or minus infinity for a cluster
    without lines. The cluster of the largest sum of w * c is then the nearest one."""
    sums = members.groupBy("doc_id", "term").agg(F.array(*[
        F.sum(F.when(F.col("cluster") == j, F.col("copies") * F.col("w")).otherwise(0.0)) for j in range(k)]).alias("s"))
    sizes = sums.where(F.col("term") == _BIAS).select("doc_id", F.col("s").alias("size"))
    means = sums.where(F.col("term") != _BIAS).join(sizes, "doc_id").select(
        "doc_id", "term", F.zip_with("s", "size", lambda s, n: F.when(n > 0, s / n).otherwise(0.0)).alias("c"))
    lengths = means.groupBy("doc_id").agg(F.array(*[F.sum(F.col("c")[j] * F.col("c")[j]) for j in range(k)]).alias("sq"))
    zeros = F.array_repeat(F.lit(0.0), k)
    bias = sizes.join(lengths, "doc_id", "left").select("doc_id", F.lit(_BIAS).alias("term"), F.zip_with(
        "size", F.coalesce("sq", zeros), lambda n, q: F.when(n > 0, -q / 2).otherwise(float("-inf"))).alias("c"))
    return means.unionByName(bias)


def _assign(points: DataFrame, centers: DataFrame, hot: DataFrame | None, k: int) -> DataFrame:
    packed = centers.withColumn("_salt", F.lit(0)) if hot is None else skew.replicate(centers, ["doc_id", "term"], hot)
    scores = points.join(packed.hint("merge"), ["doc_id", "term", "_salt"]).groupBy("doc_id", "pos").agg(
        *[F.sum(F.col("w") * F.col("c")[j]).alias(f"s{j}") for j in range(k)])
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"s{j}"), 9).alias("s"), F.lit(-j).alias("j")) for j in range(k)]))
    return scores.select("doc_id", "pos", (-best["j"]).alias("cluster"))


def _nearest_lines(sums: np.ndarray) -> np.ndarray:
    """The cluster of the largest score; equal scores (9 decimals) go to the lower number."""
    return np.round(sums, 9).argmax(1)


def _clusters_of_batch(doc_of_line: np.ndarray, first_labels: np.ndarray, copies: np.ndarray, line_of: np.ndarray, term_of: np.ndarray,
                       doc_of_term: np.ndarray, weights: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Labels of all lines of several documents. ``first_labels`` is -1 for lines that are no first center."""
    n_docs = int(doc_of_line.max()) + 1 if len(doc_of_line) else 0

    def assign(labels: np.ndarray) -> np.ndarray:
        known = labels >= 0
        sizes = np.bincount(doc_of_line[known] * k + labels[known], copies[known], n_docs * k).reshape(n_docs, k)
        used = known[line_of]
        cells = term_of[used] * k + labels[line_of[used]]
        sums = np.bincount(cells, copies[line_of[used]] * weights[used], len(doc_of_term) * k).reshape(-1, k)
        held = sizes[doc_of_term]
        centers = np.where(held > 0, sums / np.maximum(held, 1), 0.0)
        squares = np.stack([np.bincount(doc_of_term, centers[:, j] ** 2, n_docs) for j in range(k)], 1)
        bias = np.where(sizes > 0, -squares / 2, -np.inf)
        scores = np.stack([np.bincount(line_of, weights * centers[term_of, j], len(doc_of_line)) for j in range(k)], 1)
        return _nearest_lines(scores + bias[doc_of_line])

    labels = assign(first_labels)
    for _ in range(rounds):
        moved = assign(labels)
        if (moved == labels).all():
            break
        labels = moved
    return labels


def line_clusters(line_table: DataFrame, k: int = 5, rounds: int = MAX_ROUNDS, until_stable: bool = True,
                  rows_per_salt: int = ROWS_PER_SALT, lines: Collection | None = None, entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """Lloyd's rounds on the term weights of the lines of every document with at least ``k`` lines:
    ``(doc_id, pos, copies, cluster)``, one row per distinct line profile.

    Lines meet centers only on the terms they share. The first ``k`` profiles are the first centers. Documents that may have
    more than ``entries_per_task`` (line, term) entries are clustered as a table, the others whole in a task.
    """
    def fit(b: Batch) -> pa.RecordBatch:
        line, term, _, w = b.weighted()
        size = np.bincount(b.doc_of_line, minlength=b.n_docs)
        place = np.arange(len(b.pos)) - (np.cumsum(size) - size)[b.doc_of_line]  # lines come in the order of pos
        labels = _clusters_of_batch(b.doc_of_line, np.where(place < k, place, -1), b.copies.astype(float), line, term, b.doc_of_term, w, k, rounds)
        kept = np.flatnonzero(b.n_lines[b.doc_of_line] >= k)
        return pa.RecordBatch.from_arrays([b.of_lines(kept), pa.array(b.pos[kept]), pa.array(b.copies[kept]), pa.array(labels[kept].astype(np.int32))],
                                          ["doc_id", "pos", "copies", "cluster"])

    lines = lines or tfidf.collection(line_table, entries_per_task)
    whole = in_documents(lines.whole, fit, "pos bigint, copies bigint, cluster int")
    if lines.large is None:
        return whole
    profiles = tfidf.line_profiles(lines.large).withColumn("pos", F.col("pos").cast("bigint"))
    many = materialise(profiles.groupBy("doc_id").agg(F.sum("copies").alias("_n")).where(F.col("_n") >= k).select("doc_id"))
    profiles = profiles.join(many, "doc_id", "left_semi")
    apart = _clusters_in_rounds(profiles.select("doc_id", "pos", "copies"), tfidf.weighted_terms(profiles), k, rounds, until_stable, rows_per_salt)
    return whole.unionByName(apart)


def _clusters_in_rounds(profiles: DataFrame, weights: DataFrame, k: int, rounds: int, until_stable: bool, rows_per_salt: int) -> DataFrame:
    """The same for documents of any size, one pass over their rows per round."""
    weights = weights.select("doc_id", "pos", "copies", "term", "w")
    long = weights.unionByName(profiles.select("doc_id", "pos", "copies", F.lit(_BIAS).alias("term"), F.lit(1.0).alias("w")))
    long = materialise(long)
    longest = profiles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    counts = long.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("_n"))
    hot = skew.hot_keys(counts, ["doc_id", "term"], "_n", rows_per_salt) if longest > rows_per_salt else None
    points = long.withColumn("_salt", F.lit(0)) if hot is None else materialise(
        skew.add_salt(long, ["doc_id", "term"], hot, ["pos"]))
    first = Window.partitionBy("doc_id").orderBy("pos")
    ranked = profiles.select("doc_id", "pos").withColumn("cluster", F.row_number().over(first)).where(F.col("cluster") <= k)
    labels = ranked.withColumn("cluster", F.col("cluster") - 1)
    finished = None
    for i in range(rounds + 1):
        centers = _centers(long.join(labels, ["doc_id", "pos"]), k)
        moved = materialise(_assign(points, centers, hot, k))
        if not until_stable or i == 0:
            labels = moved
            continue
        # a document none of whose lines moved is done and leaves the table
        active = materialise(moved.join(labels, ["doc_id", "pos", "cluster"], "left_anti").select("doc_id").distinct())
        done = moved.join(active, "doc_id", "left_anti")
        finished = done if finished is None else finished.unionByName(done)
        if active.isEmpty():
            labels = moved.limit(0)
            break
        labels = materialise(moved.join(active, "doc_id", "left_semi"))
        long, points = long.join(active, "doc_id", "left_semi"), points.join(active, "doc_id", "left_semi")
    labels = labels if finished is None else finished.unionByName(labels)
    return profiles.select("doc_id", "pos", "copies").join(labels, ["doc_id", "pos"])


def line_cluster_features(line_table: DataFrame, n_clusters: int = 5, rounds: int = MAX_ROUNDS, lines: Collection | None = None) -> DataFrame:
    """``num_clusters`` and ``dominant_cluster_ratio`` of the term weights; n and 1.0 below ``n_clusters`` lines."""
    lines = lines or tfidf.collection(line_table)
    labels = line_clusters(line_table, n_clusters, rounds, lines=lines)
    found = labels.groupBy("doc_id", "cluster").agg(F.sum("copies").alias("size")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_clusters"), (F.max("size") / F.sum("size")).alias("_ratio"))
    return line_table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("_clusters", "_n").alias("num_clusters"), F.coalesce("_ratio", F.lit(1.0)).alias("dominant_cluster_ratio"))
