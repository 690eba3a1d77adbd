"""Queries over event times and line vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import clustering, semantic, timing
from cuesheet.sources.tables import read_table
from workload import inputs
from workload.text import rounded

HOUR = 3600


def _cues(s, sf, key):
    return timing.event_cues(read_table(s, sf, "events"), key, inputs.event_ms(), "event_id")


def _event_gaps(s, sf):
    gaps = timing.line_gaps(_cues(s, sf, "user_id"))
    return rounded(gaps.select("event_id", F.col("doc_id").alias("user_id"), "gap_seconds"))


def _named(df, key):
    return rounded(df.withColumnRenamed("doc_id", key))


def _event_density(s, sf):
    cues = _cues(s, sf, "user_id")
    return _named(timing.dialogue_density(cues, cues), "user_id")


def _gap_density(s, sf):
    cues = _cues(s, sf, "event_type")
    return _named(timing.scene_change_density(cues, cues, HOUR), "event_type")


def _labels(s, sf):
    return clustering.grouped_kmeans(inputs.vectors(s, sf), k=3, rounds=2, until_stable=False)


def _grouped_kmeans(s, sf):
    sizes = clustering.cluster_sizes(_labels(s, sf)).withColumnRenamed("doc_id", "label")
    return sizes.withColumn("cluster", F.col("cluster").cast("bigint"))


QUERIES = {
    "event_gaps": _event_gaps,
    "stream_duration": lambda s, sf: _named(timing.duration_seconds(_cues(s, sf, "user_id")), "user_id"),
    "event_density": _event_density,
    "gap_density": _gap_density,
    "semantic_variance": lambda s, sf: _named(semantic.semantic_variance(inputs.vectors(s, sf)), "label"),
    "pairwise_similarity": lambda s, sf: _named(semantic.pairwise_similarity(inputs.vectors(s, sf)), "label"),
    "coherence": lambda s, sf: _named(semantic.coherence(inputs.vectors(s, sf)), "label"),
    "grouped_kmeans": _grouped_kmeans,
    "num_clusters": lambda s, sf: _named(clustering.cluster_features(_labels(s, sf), 3).select("doc_id", "num_clusters"), "label"),
    "dominant_cluster_ratio": lambda s, sf: _named(clustering.cluster_features(_labels(s, sf), 3).select("doc_id", "dominant_cluster_ratio"), "label"),
}

_T = "(epoch_us(ts) // 1000)"
_UNIT = """unit AS (SELECT label, vec_id, list_transform(v, lambda x: x / len) AS u FROM (
        SELECT label, vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"""
_POINTS = """points AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    seeds AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS cluster FROM (
        SELECT label, v, min(vec_id) AS vec_id FROM points GROUP BY label, v) QUALIFY cluster <= 3),
    c0 AS (SELECT label, cluster, i, v[i] AS x FROM seeds, range(1, 65) AS r(i))"""


def _round(n: int) -> str:
    return f"""d{n} AS (SELECT p.label, p.vec_id, c.cluster, round(sum((p.v[c.i] - c.x) ** 2), 9) AS d FROM points p JOIN c{n} c ON p.label = c.label GROUP BY ALL),
    a{n} AS (SELECT label, vec_id, cluster FROM d{n} QUALIFY row_number() OVER (PARTITION BY label, vec_id ORDER BY d, cluster) = 1),
    c{n + 1} AS (SELECT a.label, a.cluster, i, avg(p.v[i]) AS x FROM a{n} a JOIN points p USING (label, vec_id), range(1, 65) AS r(i) GROUP BY ALL)"""


_KMEANS = f"WITH {_POINTS}, {_round(0)}, {_round(1)}, {_round(2)}, sizes AS (SELECT label, cluster, count(*) AS size FROM a2 GROUP BY ALL)"

ORACLES = {
    "event_gaps": f"SELECT event_id, user_id, ({_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY {_T}, event_id)) / 1000 AS gap_seconds FROM events",
    "stream_duration": f"SELECT user_id, (max({_T}) - min({_T})) / 1000 AS duration_seconds FROM events GROUP BY user_id",
    "event_density": f"SELECT user_id, CASE WHEN max({_T}) > min({_T}) THEN count(*) / ((max({_T}) - min({_T})) / 1000 / 60) ELSE 0 END AS dialogue_density FROM events GROUP BY user_id",
    "gap_density": f"""SELECT event_type, sum(CASE WHEN g >= {HOUR * 1000} THEN 1 ELSE 0 END) / ((max(t) - min(t)) / 1000 / 60) AS scene_change_density
        FROM (SELECT event_type, {_T} AS t, {_T} - lag({_T}) OVER (PARTITION BY event_type ORDER BY {_T}, event_id) AS g FROM events) GROUP BY event_type""",
    "semantic_variance": "SELECT label, round(avg(v), 6) AS semantic_variance FROM (SELECT label, i, var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY label",
    "pairwise_similarity": f"WITH {_UNIT} SELECT a.label, round(avg(list_dot_product(a.u, b.u)), 6) AS semantic_similarity_score FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label",
    "coherence": f"""WITH {_UNIT} SELECT label, round(avg(list_dot_product(u, p)), 6) AS coherence_score
        FROM (SELECT label, u, lag(u) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM unit) WHERE p IS NOT NULL GROUP BY label""",
    "grouped_kmeans": f"{_KMEANS} SELECT label, cluster, size FROM sizes",
    "num_clusters": f"{_KMEANS} SELECT label, CASE WHEN sum(size) < 3 THEN sum(size)::BIGINT ELSE count(*) END AS num_clusters FROM sizes GROUP BY label",
    "dominant_cluster_ratio": f"{_KMEANS} SELECT label, CASE WHEN sum(size) < 3 THEN 1.0 ELSE max(size) / sum(size) END AS dominant_cluster_ratio FROM sizes GROUP BY label",
}
