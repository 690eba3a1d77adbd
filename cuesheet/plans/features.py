"""The feature job: cues of any number of documents to one row of features per document."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import naming
from cuesheet.functions.wordlists import INTENSITY_WORDS, STOP_WORDS
from cuesheet.operators import clustering, lexical, lexicon, lines, merging, selection, semantic, tfidf, timing, topics
from cuesheet.session import materialise, written
from cuesheet.sources import corpus, metadata, tables

# The columns of the feature table and their order.
FEATURE_COLUMNS = {
    "line_count": "bigint", "word_count": "bigint", "avg_sentence_length": "double", "lexical_diversity": "double",
    "tfidf_keywords": "array<string>", "repetition_rate": "double", "stopword_ratio": "double",
    "avg_sentiment": "double", "sentiment_std": "double", "question_rate": "double",
    "emotion_distribution": "map<string,double>", "exclamation_rate": "double", "intensity_score": "double",
    "num_clusters": "bigint", "dominant_cluster_ratio": "double", "semantic_variance": "double",
    "pos_distribution": "map<string,double>", "pronoun_usage": "double", "tense_distribution": "map<string,double>",
    "dialogue_density": "double", "duration_seconds": "double", "scene_change_density": "double",
    "topic_distribution": "array<double>", "semantic_similarity_score": "double", "coherence_score": "double",
}
# Names of labels and feature groups.
LABEL_COLUMNS = {"imdbID": "string", "rating": "double", "votes": "bigint"}
FEATURE_GROUPS = {
    "linguistic_features": ("line_count", "word_count", "avg_sentence_length", "lexical_diversity", "tfidf_keywords",
                            "repetition_rate", "stopword_ratio"),
    "sentiment_style_features": ("avg_sentiment", "sentiment_std", "question_rate", "emotion_distribution", "exclamation_rate",
                                 "intensity_score"),
    "clustering_content_features": ("num_clusters", "dominant_cluster_ratio", "semantic_variance"),
    "syntactic_grammatical_features": ("pos_distribution", "pronoun_usage", "tense_distribution"),
    "structural_features": ("dialogue_density", "duration_seconds", "scene_change_density"),
    "semantic_features": ("topic_distribution", "semantic_similarity_score", "coherence_score"),
}


@dataclass
class Resources:
    """What the features need besides the cues. A part that is missing leaves its features null.

    ``polarity`` is (word, polarity), ``emotions`` (word, emotion, value), ``tags`` (word, pos, tag), ``vectors``
    (doc_id, pos, vector) with one vector per line.
    """

    polarity: DataFrame | None = None
    emotions: DataFrame | None = None
    tags: DataFrame | None = None
    vectors: DataFrame | None = None
    stop_words: Sequence[str] = field(default_factory=lambda: tuple(STOP_WORDS))
    intensity_words: Sequence[str] = field(default_factory=lambda: tuple(INTENSITY_WORDS))
    top_n: int = 10
    similarity_threshold: float = 0.95
    n_clusters: int = 5
    cluster_rounds: int = clustering.MAX_ROUNDS
    threshold_seconds: float = 20
    n_topics: int = 5
    topics_per_document: bool = True
    markup: bool = True


def document_features(cues: DataFrame, resources: Resources | None = None,
                      wanted: Sequence[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """One row per document that has cues: ``doc_id`` and the wanted features, in the fixed order.

    Each family of features makes one small table per document; they are joined on the id at the end. What several
    families read (cues, token counts, term counts of gathered lines) is computed once and written.
    """
    r = resources or Resources()
    want = set(wanted)
    cues = written(cues, "cues")
    line_table = lines.lines(cues, r.markup)
    grammatical = r.tags is not None and bool(want & set(FEATURE_GROUPS["syntactic_grammatical_features"]))
    emotional = r.emotions is not None and "emotion_distribution" in want
    clustered = bool(want & {"num_clusters", "dominant_cluster_ratio"})
    counts = gathered = None
    if "lexical_diversity" in want or grammatical or emotional:
        counts = written(lines.token_counts(line_table), "counts")
    if clustered or want & {"tfidf_keywords", "repetition_rate"} or ("topic_distribution" in want and r.topics_per_document):
        gathered = tfidf.collection(line_table).kept()

    parts: list[DataFrame] = [lexical.lexical_profile(line_table, r.stop_words, r.intensity_words)]
    if "lexical_diversity" in want:
        parts.append(lexical.lexical_diversity(line_table, counts))
    if "tfidf_keywords" in want:
        parts.append(tfidf.keyword_lists(line_table, r.top_n, r.stop_words, gathered))
    if "repetition_rate" in want:
        parts.append(tfidf.repetition_rate(line_table, r.similarity_threshold, gathered))
    if r.polarity is not None and want & {"avg_sentiment", "sentiment_std"}:
        parts.append(lexicon.sentiment(line_table, r.polarity))
    if emotional:
        parts.append(lexicon.emotion_distribution(line_table, r.emotions, counts=counts))
    if grammatical:
        parts.append(lexicon.grammar(line_table, r.tags, counts))
    elif "pronoun_usage" in want:
        parts.append(lexicon.pronoun_usage(line_table))
    if clustered:
        parts.append(clustering.line_cluster_features(line_table, r.n_clusters, r.cluster_rounds, gathered))
    if r.vectors is not None and want & {"semantic_variance", "semantic_similarity_score", "coherence_score"}:
        parts += [semantic.semantic_variance(r.vectors), semantic.pairwise_similarity(r.vectors), semantic.coherence(r.vectors)]
    if "start_ms" in cues.columns and want & set(FEATURE_GROUPS["structural_features"]):
        parts.append(timing.timing_profile(cues, line_table, r.threshold_seconds))
    if "topic_distribution" in want:
        parts.append(topics.topic_distribution(line_table, r.n_topics, per_document=r.topics_per_document, lines=gathered))
    out = cues.select("doc_id").distinct()
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return _completed(out, wanted, r.n_topics)


def _completed(df: DataFrame, wanted: Sequence[str], n_topics: int) -> DataFrame:
    """Fixed names, types and order. Documents whose cues are all blank get the values of an empty document."""
    empty = {"tfidf_keywords": F.array().cast("array<string>"),
             "topic_distribution": F.array_repeat(F.lit(0.0), n_topics)}
    no_default = {"emotion_distribution", "pos_distribution", "tense_distribution"}
    columns = []
    for name in (c for c in FEATURE_COLUMNS if c in wanted):
        kind = FEATURE_COLUMNS[name]
        if name not in df.columns:
            columns.append(F.lit(None).cast(kind).alias(name))
        elif name in no_default:
            columns.append(F.col(name).cast(kind).alias(name))
        else:
            columns.append(F.coalesce(F.col(name), empty.get(name, F.lit(0))).cast(kind).alias(name))
    return df.select("doc_id", *columns)


def grouped_features(features: DataFrame) -> DataFrame:
    """One struct column per feature group."""
    return features.select("doc_id", *[F.struct(*names).alias(group) for group, names in FEATURE_GROUPS.items()])


def flat_features(grouped: DataFrame) -> DataFrame:
    """Back to one column per feature, in the fixed order."""
    return grouped.select("doc_id", *[f"{group}.*" for group in FEATURE_GROUPS]).select("doc_id", *FEATURE_COLUMNS)


def labelled_features(features: DataFrame, episodes: DataFrame) -> DataFrame:
    """Attach id and labels; a missing rating or vote count becomes 0. ``episodes`` has (doc_id, imdb_id, rating, votes)."""
    labels = episodes.select("doc_id", F.col("imdb_id").alias("imdbID"), F.coalesce("rating", F.lit(0.0)).alias("rating"),
                             F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"))
    return features.join(labels, "doc_id").select(*features.columns[1:], *LABEL_COLUMNS)


def output_schema() -> str:
    return ", ".join(f"`{n}` {t}" for n, t in {**FEATURE_COLUMNS, **LABEL_COLUMNS}.items())


def single_file_features(spark: SparkSession, path: str, resources: Resources | None = None) -> DataFrame:
    """Features of one subtitle file; no rows where it cannot be read as subtitles."""
    files = corpus.read_files(spark, path, glob="*")
    return document_features(corpus.read_cues(files), resources)


def corpus_features(spark: SparkSession, base: str, out: str, resources: Resources | None = None, encoding: str = "UTF-8",
                    extract: Callable[[DataFrame, Resources | None], DataFrame] = document_features) -> tuple[DataFrame, DataFrame]:
    """The whole job: episodes that are marked as having subtitles and are not in the output yet get their features
    and are appended to it. Returns the output table and the rejects ``(doc_id, reason)``.

    An episode's file is found by the path in its metadata, whatever scheme and host either side names: an archive,
    whose first member is read, or a plain file. Files are listed without their content, and only those of episodes
    still to do are opened. Rejected are files without cues, archives that cannot be read, and paths that do not exist.
    """
    episodes = selection.with_subtitles(metadata.read_season_metadata(spark, base)).where(F.col("imdb_id").isNotNull())
    done = tables.read_if_exists(spark, out, output_schema())
    todo = merging.not_yet_done(episodes.withColumnRenamed("imdb_id", "imdbID"), done, "imdbID") \
        .withColumnRenamed("imdbID", "imdb_id").select("subtitles_full_path", "imdb_id", "rating", "votes")
    todo = materialise(todo.where(F.col("subtitles_full_path").isNotNull()).withColumn("key", corpus.path_key(F.col("subtitles_full_path"))))
    wanted = todo.select("key").distinct()
    listed = materialise(corpus.list_files(spark, base).join(wanted, "key", "left_semi"))
    # the reader takes the paths as arguments and keeps them on the driver anyway
    paths = [re.sub(r"([\\*?{}\[\]])", r"\\\1", r["path"]) for r in listed.select(naming.decoded_path(F.col("path")).alias("path")).collect()]
    zips = [p for p in paths if p.endswith(".zip")]
    texts = [p for p in paths if not p.endswith(".zip")]
    parts, unread = [], []
    if texts:
        parts.append(corpus.read_files(spark, texts, encoding=encoding).select("path", "content").withColumn("key", corpus.path_key(F.col("path"))))
    if zips:
        members = materialise(corpus.expand_archives(spark, zips, first_only=True))
        parts.append(corpus.first_members(members, encoding).select("path", "content", corpus.path_key(F.col("archive")).alias("key")))
        unread.append(members.where(F.col("reason").isNotNull()).select(F.col("path").alias("doc_id"), "reason"))
    unread.append(todo.join(listed.select("key").distinct(), "key", "left_anti").select(
        F.col("subtitles_full_path").alias("doc_id"), F.lit("file does not exist").alias("reason")).distinct())
    empty = spark.createDataFrame([], "path string, content string, key string")
    files = materialise(reduce(DataFrame.unionByName, parts, empty))
    cues = corpus.read_cues(files)
    features = extract(cues, resources)
    labels = files.select(F.col("path").alias("doc_id"), "key").join(todo, "key")
    rows = materialise(labelled_features(features, labels))
    tables.write_features(rows, out)
    rejected = reduce(DataFrame.unionByName, unread, corpus.rejects(files, cues))
    return tables.read_if_exists(spark, out, output_schema()), rejected
