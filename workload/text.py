"""Queries over lines, tokens, term weights and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import encoding, lexical, lexicon, lines, merging, tfidf
from cuesheet.plans import features
from cuesheet.session import materialise
from cuesheet.sources.tables import read_table, spread
from workload import inputs, sql

FUNCTION_WORDS = ["the", "of", "and", "with", "les", "und", "para"]
EMOTION_COLUMNS = ["anger", "fear", "joy", "trust"]


# sums of fractions, whose last bits depend on the order; everything else must agree exactly
INEXACT = {
    "weight", "avg_sentiment", "sentiment_std", "semantic_variance", "semantic_similarity_score", "coherence_score", "rmse", "mae", "r2", "explained_variance", "mean", "std",
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in INEXACT else F.col(f"`{c}`") for c in df.columns])


def _flat_grammar(df: DataFrame) -> DataFrame:
    if "pos_distribution" in df.columns:
        df = encoding.expand_dict(df, "pos_distribution", "pos", ["noun", "verb", "adjective"])
    if "tense_distribution" in df.columns:
        df = encoding.expand_dict(df, "tense_distribution", "tense", ["past", "present", "future"])
    return df


def _over_lines(feature):
    return lambda spark, sf: rounded(feature(inputs.document_lines(spark, sf)))


def _intensity(spark, sf):
    line_table = inputs.document_lines(spark, sf)
    return rounded(lexical.intensity_score(line_table).join(
        lexical.word_share(line_table, FUNCTION_WORDS, "function_word_score"), "doc_id"))


def _question_rate(spark, sf):
    pages = read_table(spark, sf, "pages")
    urls = pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("doc_id"), F.col("url").alias("line"))
    return rounded(lexical.question_rate(urls).withColumnRenamed("doc_id", "host"))


def _conversation_profile(spark, sf):
    talk = spread(read_table(spark, sf, "conversations"), "conv_id")
    cues = talk.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    profile = lexical.lexical_profile(lines.lines(cues)).withColumnRenamed("doc_id", "conv_id")
    return rounded(profile.select("conv_id", "line_count", "word_count", "avg_sentence_length", "stopword_ratio"))


def _vocab_topk(spark, sf):
    return encoding.top_values(lines.document_tokens(inputs.document_lines(spark, sf)), "tok", 500)


def _vocab_intersect(spark, sf):
    docs = lines.document_tokens(inputs.document_lines(spark, sf)).select("tok")
    other = read_table(spark, sf, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("tok"))
    return docs.intersect(other)


def _keyword_multihot(spark, sf):
    lists = materialise(tfidf.keyword_lists(inputs.document_lines(spark, sf)))
    vocabulary = encoding.keyword_vocabulary(lists, "tfidf_keywords", 500)
    wide = encoding.multi_hot(lists, vocabulary)
    return wide.select("doc_id", F.concat(*[F.col(f"`kw_{w}`").cast("string") for w in vocabulary]).alias("bits"))


def document_feature_table(spark, sf):
    """All 25 features of every document, with its labels. Of the topic mixture, what SQL can tell: its size and sum."""
    cues = inputs.timed_cues(spark, sf)
    resources = features.Resources(
        polarity=inputs.polarity(spark, sf), emotions=inputs.emotions(spark, sf), tags=inputs.tags(spark, sf),
        vectors=inputs.line_vectors(lines.lines(cues)))
    table = features.document_features(cues, resources)
    table = encoding.expand_dict(_flat_grammar(table), "emotion_distribution", "emotion", EMOTION_COLUMNS)
    parts = F.col("topic_distribution")
    table = table.withColumn("tfidf_keywords", F.concat_ws(" ", "tfidf_keywords")).withColumns({
        "topics": F.size(parts).cast("bigint"), "topic_total": F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6)}).drop("topic_distribution")
    marks = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("rating"), F.col("toxic").alias("votes"))
    joined = table.join(marks, "doc_id", "left")
    return rounded(joined.withColumns({"rating": F.coalesce("rating", F.lit(0)), "votes": F.coalesce("votes", F.lit(0))}))


def _join_features(spark, sf):
    metadata = read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("imdbID"), F.col("quality").alias("rating"), F.col("toxic").alias("votes"))
    profile = lexical.lexical_profile(inputs.document_lines(spark, sf))
    side = profile.select(F.concat(F.lit("tt"), F.col("doc_id").cast("string")).alias("imdbID"), "line_count", "word_count",
                          "avg_sentence_length", F.lit(0).alias("rating"), F.lit(0).alias("votes"))
    return rounded(merging.merge_features(metadata, side))


def _append_features(spark, sf):
    counts = lexical.lexical_profile(inputs.document_lines(spark, sf)).select("doc_id", "line_count", "word_count")
    marks = read_table(spark, sf, "labels")
    old = counts.join(marks, "doc_id", "left_semi").drop("word_count")
    return merging.append_rows(old, merging.not_yet_done(counts, marks, "doc_id"))


QUERIES = {
    "doc_lines": lambda s, sf: inputs.document_lines(s, sf),
    "line_count": _over_lines(lexical.line_count),
    "word_count": _over_lines(lexical.word_count),
    "avg_sentence_length": _over_lines(lexical.avg_sentence_length),
    "lexical_diversity": _over_lines(lexical.lexical_diversity),
    "stopword_ratio": _over_lines(lexical.stopword_ratio),
    "exclamation_rate": _over_lines(lexical.exclamation_rate),
    "intensity_score": _intensity,
    "question_rate": _question_rate,
    "conversation_profile": _conversation_profile,
    "vocab_topk": _vocab_topk,
    "vocab_intersect": _vocab_intersect,
    "line_tfidf": _over_lines(tfidf.line_tfidf),
    "tfidf_keywords": lambda s, sf: tfidf.tfidf_keywords(inputs.document_lines(s, sf)).select("doc_id", "rank", "term"),
    "repetition_rate": _over_lines(tfidf.repetition_rate),
    "keyword_multihot": _keyword_multihot,
    "lexicon_pivot": lambda s, sf: lexicon.pivot_lexicon(inputs.emotions(s, sf)),
    "lexicon_coverage": lambda s, sf: lexicon.lexicon_coverage(inputs.document_lines(s, sf), inputs.benchmark_words(s, sf)),
    "avg_sentiment": lambda s, sf: rounded(lexicon.avg_sentiment(inputs.document_lines(s, sf), inputs.polarity(s, sf))),
    "sentiment_std": lambda s, sf: rounded(lexicon.sentiment_std(inputs.document_lines(s, sf), inputs.polarity(s, sf))),
    "emotion_distribution": lambda s, sf: rounded(lexicon.emotion_columns(inputs.document_lines(s, sf), inputs.emotions(s, sf))),
    "pos_distribution": lambda s, sf: rounded(_flat_grammar(lexicon.pos_distribution(inputs.document_lines(s, sf), inputs.tags(s, sf)))),
    "tense_distribution": lambda s, sf: rounded(_flat_grammar(lexicon.tense_distribution(inputs.document_lines(s, sf), inputs.tags(s, sf)))),
    "pronoun_usage": _over_lines(lexicon.pronoun_usage),
    "doc_feature_table": document_feature_table,
    "join_features": _join_features,
    "append_features": _append_features,
}


def _share(words: str) -> str:
    return f"sum(CASE WHEN tok IN ({words}) THEN 1 ELSE 0 END) / count(*)"


_BASE = f"WITH {sql.LINES}, {sql.TOKENS}"
_LEX = f"{_BASE}, {sql.WORDS}"
_PROFILE = f"""{sql.LINES}, {sql.TOKENS},
sentences AS (SELECT doc_id, pos, unnest(string_split(regexp_replace(line, '([.!?])[{sql.SPACES}]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM lines),
asl AS (SELECT doc_id, avg(len(regexp_extract_all(s, '{sql.TOKEN}'))) AS avg_sentence_length FROM sentences GROUP BY doc_id),
lc AS (SELECT doc_id, count(*) AS line_count, avg(CASE WHEN contains(line, '?') THEN 1 ELSE 0 END) AS question_rate,
       avg(CASE WHEN line LIKE '%!' THEN 1 ELSE 0 END) AS exclamation_rate FROM lines GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS word_count, count(DISTINCT tok) / count(*) AS lexical_diversity,
       sum(CASE WHEN tok IN ({sql.STOP}) THEN 1 ELSE 0 END) / count(*) AS stopword_ratio,
       sum(CASE WHEN tok IN ({sql.INTENSE}) THEN 1 ELSE 0 END) / count(*) AS intensity_score FROM tokens GROUP BY doc_id)"""
_KEYWORD_TABLE = f"kw AS (WITH {sql.KEYWORDS} SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS tfidf_keywords FROM keywords GROUP BY doc_id)"
_REPETITION_TABLE = f"rep AS (WITH {sql.tfidf(False)}, {sql.REPETITION} SELECT * FROM repetition)"

_TIMING = """last AS (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS pos FROM documents),
started AS (SELECT doc_id, pos, pos * 4000 + (pos // 5) * 20000 AS begun FROM lines),
scenes AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN begun - before >= 20000 THEN 1 ELSE 0 END) AS scenes
           FROM (SELECT doc_id, begun, lag(begun) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM started) GROUP BY doc_id),
timing AS (SELECT doc_id, (pos * 4000 + (pos // 5) * 20000 + 1500) / 1000 AS duration_seconds, n / (duration_seconds / 60) AS dialogue_density,
           scenes / (duration_seconds / 60) AS scene_change_density FROM last JOIN scenes USING (doc_id))"""
_VECTORS = """vec AS (SELECT doc_id, pos, [length(line) / 7, len(regexp_extract_all(line, '[a-z]')) / 7, (len(regexp_extract_all(line, ' ')) + 1) / 7]::DOUBLE[] AS v FROM lines),
units AS (SELECT doc_id, pos, list_transform(v, lambda x: x / length) AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS length FROM vec)),
spread AS (SELECT doc_id, (var_pop(v[1]) + var_pop(v[2]) + var_pop(v[3])) / 3 AS semantic_variance FROM vec GROUP BY doc_id),
alike AS (SELECT l.doc_id, coalesce(avg(list_dot_product(a.u, b.u)), 0) AS semantic_similarity_score
          FROM lc l LEFT JOIN units a ON a.doc_id = l.doc_id LEFT JOIN units b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY l.doc_id),
coherent AS (SELECT doc_id, coalesce(avg(list_dot_product(u, p)), 0) AS coherence_score
             FROM (SELECT doc_id, u, lag(u) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM units) GROUP BY doc_id)"""

ORACLES = {
    "doc_lines": f"WITH {sql.LINES} SELECT doc_id, pos::BIGINT AS pos, line FROM lines",
    "line_count": f"WITH {sql.LINES} SELECT doc_id, count(*) AS line_count FROM lines GROUP BY doc_id",
    "word_count": f"{_BASE} SELECT doc_id, count(*) AS word_count FROM tokens GROUP BY doc_id",
    "avg_sentence_length": f"WITH {_PROFILE} SELECT doc_id, avg_sentence_length AS avg_sentence_length FROM asl",
    "lexical_diversity": f"{_BASE} SELECT doc_id, count(DISTINCT tok) / count(*) AS lexical_diversity FROM tokens GROUP BY doc_id",
    "stopword_ratio": f"{_BASE} SELECT doc_id, {_share(sql.STOP)} AS stopword_ratio FROM tokens GROUP BY doc_id",
    "exclamation_rate": f"WITH {sql.LINES} SELECT doc_id, avg(CASE WHEN line LIKE '%!' THEN 1 ELSE 0 END) AS exclamation_rate FROM lines GROUP BY doc_id",
    "intensity_score": f"{_BASE} SELECT doc_id, {_share(sql.INTENSE)} AS intensity_score, {_share(sql.word_set(FUNCTION_WORDS))} AS function_word_score FROM tokens GROUP BY doc_id",
    "question_rate": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, avg(CASE WHEN contains(url, '?') THEN 1 ELSE 0 END) AS question_rate FROM pages GROUP BY 1",
    "conversation_profile": f"""WITH lines AS (SELECT conv_id AS doc_id, turn AS pos, replace(trim(text, ' ' || chr(10)), chr(10), ' ') AS line
        FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''), {sql.TOKENS}, {_PROFILE.split(sql.TOKENS + ",", 1)[1]}
        SELECT doc_id AS conv_id, line_count, word_count, avg_sentence_length AS avg_sentence_length, stopword_ratio AS stopword_ratio
        FROM lc JOIN wc USING (doc_id) JOIN asl USING (doc_id)""",
    "vocab_topk": f"{_BASE} SELECT tok, count(*) AS n FROM tokens GROUP BY tok ORDER BY n DESC, tok LIMIT 500",
    "vocab_intersect": f"{_BASE} SELECT tok FROM tokens INTERSECT SELECT unnest(regexp_extract_all(lower(text), '{sql.TOKEN}')) AS tok FROM benchmark",
    "line_tfidf": f"WITH {sql.tfidf(False)} SELECT doc_id, pos::BIGINT AS pos, term, round(weight, 6) AS weight FROM u",
    "tfidf_keywords": f"WITH {sql.KEYWORDS} SELECT doc_id, rank::INT AS rank, term FROM keywords",
    "repetition_rate": f"WITH {sql.tfidf(False)}, {sql.REPETITION} SELECT doc_id, repetition_rate AS repetition_rate FROM repetition",
    "keyword_multihot": f"""WITH {sql.KEYWORDS},
        vocab AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) AS r FROM (SELECT term, count(*) AS c FROM keywords GROUP BY term) QUALIFY r <= 500),
        docs AS (SELECT DISTINCT doc_id FROM lines)
        SELECT d.doc_id, string_agg(CASE WHEN k.term IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.r) AS bits
        FROM docs d JOIN vocab v ON true LEFT JOIN keywords k ON k.doc_id = d.doc_id AND k.term = v.term GROUP BY d.doc_id""",
    "lexicon_pivot": f"""WITH {sql.WORDS}, {sql.EMOTIONS} SELECT word,
        coalesce(max(value) FILTER (emotion = 'anger'), 0) AS anger, coalesce(max(value) FILTER (emotion = 'fear'), 0) AS fear,
        coalesce(max(value) FILTER (emotion = 'joy'), 0) AS joy, coalesce(max(value) FILTER (emotion = 'trust'), 0) AS trust
        FROM emotions GROUP BY word""",
    "lexicon_coverage": f"{_LEX} SELECT doc_id, count(DISTINCT w.word) AS lexicon_words FROM tokens t LEFT JOIN words w ON t.tok = w.word GROUP BY doc_id",
    "avg_sentiment": f"{_LEX}, {sql.POLARITY}, {sql.LINE_POLARITY} SELECT doc_id, round(avg(polarity), 6) AS avg_sentiment FROM line_polarity GROUP BY doc_id",
    "sentiment_std": f"{_LEX}, {sql.POLARITY}, {sql.LINE_POLARITY} SELECT doc_id, round(stddev_pop(polarity), 6) AS sentiment_std FROM line_polarity GROUP BY doc_id",
    "emotion_distribution": f"{_LEX}, {sql.EMOTIONS}, {sql.EMOTION_SUMS} SELECT doc_id, " + ", ".join(
        f"emotion_{e} AS emotion_{e}" for e in EMOTION_COLUMNS) + " FROM emo",
    "pos_distribution": f"{_LEX}, {sql.TAGS}, {sql.GRAMMAR} SELECT doc_id, pos_noun AS pos_noun, pos_verb AS pos_verb, pos_adjective AS pos_adjective FROM shares",
    "tense_distribution": f"{_LEX}, {sql.TAGS}, {sql.GRAMMAR} SELECT doc_id, tense_past AS tense_past, tense_present AS tense_present, tense_future AS tense_future FROM shares",
    "pronoun_usage": f"{_BASE} SELECT doc_id, {_share(sql.PRON)} AS pronoun_usage FROM tokens GROUP BY doc_id",
    "doc_feature_table": f"""WITH {_PROFILE}, {sql.WORDS}, {sql.POLARITY}, {sql.LINE_POLARITY}, {sql.EMOTIONS}, {sql.EMOTION_SUMS},
        {sql.TAGS}, {sql.GRAMMAR}, {_KEYWORD_TABLE}, {_REPETITION_TABLE},
        sent AS (SELECT doc_id, avg(polarity) AS avg_sentiment, stddev_pop(polarity) AS sentiment_std FROM line_polarity GROUP BY doc_id),
        clu AS ({sql.line_clusters()}), {_TIMING}, {_VECTORS}
        SELECT lc.doc_id, line_count, word_count, coalesce(tfidf_keywords, '') AS tfidf_keywords, num_clusters, 5::BIGINT AS topics, 1.0::DOUBLE AS topic_total, """ + ", ".join(
        f"round({c}, 6) AS {c}" if c in INEXACT else c for c in (
            "avg_sentence_length", "lexical_diversity", "repetition_rate", "stopword_ratio", "avg_sentiment", "sentiment_std",
            "question_rate", "exclamation_rate", "intensity_score", "pronoun_usage", "pos_noun", "pos_verb", "pos_adjective",
            "tense_past", "tense_present", "tense_future", "emotion_anger", "emotion_fear", "emotion_joy", "emotion_trust",
            "dominant_cluster_ratio", "semantic_variance", "semantic_similarity_score", "coherence_score", "dialogue_density", "duration_seconds",
            "scene_change_density")) + """,
        coalesce(quality, 0) AS rating, coalesce(toxic, 0) AS votes
        FROM lc JOIN wc USING (doc_id) JOIN asl USING (doc_id) JOIN sent USING (doc_id) JOIN emo USING (doc_id) JOIN shares USING (doc_id)
        JOIN rep USING (doc_id) JOIN clu USING (doc_id) JOIN timing USING (doc_id) JOIN spread USING (doc_id) JOIN alike USING (doc_id)
        JOIN coherent USING (doc_id) LEFT JOIN kw USING (doc_id) LEFT JOIN labels USING (doc_id)""",
    "join_features": f"""WITH {_PROFILE} SELECT doc_id AS imdbID, quality AS rating, toxic AS votes, line_count, word_count,
        avg_sentence_length AS avg_sentence_length FROM labels JOIN lc USING (doc_id) JOIN wc USING (doc_id) JOIN asl USING (doc_id)""",
    "append_features": f"""{_BASE}, c AS (SELECT doc_id, count(*) AS word_count FROM tokens GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS line_count FROM lines GROUP BY doc_id)
        SELECT doc_id, line_count, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN NULL ELSE word_count END AS word_count
        FROM l JOIN c USING (doc_id)""",
}
