import pytest
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import lexical, lines, tfidf, timing


@pytest.fixture
def line_table(cues):
    return lines.lines(cues)


def test_lines_drop_blank_and_keep_order(line_table):
    got = [(r.pos, r.line) for r in line_table.orderBy("pos").collect()]
    assert got == [(1, "Run away!"), (2, "Why? Who is it?"), (4, "Run away!"), (5, "No! Never. Stop")]


@pytest.mark.parametrize("feature, want", [
    (lexical.line_count, 4), (lexical.word_count, 17), (lexical.avg_sentence_length, 17 / 7),
    (lexical.lexical_diversity, 12 / 17), (lexical.question_rate, 1 / 4), (lexical.exclamation_rate, 2 / 4),
    (lexical.intensity_score, 1 / 17), (tfidf.repetition_rate, 1 / 6),
])
def test_counting_features(line_table, by_id, feature, want):
    assert by_id(feature(line_table))["d"] == pytest.approx(want)


def test_profile_agrees_with_single_features(line_table):
    row = lexical.lexical_profile(line_table).first().asDict()
    for feature in (lexical.line_count, lexical.word_count, lexical.avg_sentence_length, lexical.stopword_ratio,
                    lexical.question_rate, lexical.exclamation_rate, lexical.intensity_score):
        single = feature(line_table).first().asDict()
        name = next(k for k in single if k != "doc_id")
        assert row[name] == pytest.approx(single[name])


def test_timing(cues, line_table):
    row = timing.timing_profile(cues, line_table).first()
    assert row.duration_seconds == 120.0
    assert row.dialogue_density == 2.0
    assert row.scene_change_density == 1.0  # gaps of 4, 20 and 65 seconds; the threshold is inclusive


def test_timing_of_short_and_empty_documents(spark):
    cues = spark.createDataFrame([("one", 0, 0, 6_000, "Hi"), ("zero", 0, 0, 0, "Hi"), ("blank", 0, 0, 9_000, " ")],
                                 "doc_id string, pos bigint, start_ms bigint, end_ms bigint, text string")
    got = {r.doc_id: r for r in timing.timing_profile(cues, lines.lines(cues)).collect()}
    assert (got["one"].dialogue_density, got["one"].scene_change_density) == (10.0, 0.0)
    assert (got["zero"].duration_seconds, got["zero"].dialogue_density) == (0.0, 0.0)
    assert (got["blank"].duration_seconds, got["blank"].dialogue_density) == (9.0, 0.0)


def test_tokens_and_sentences(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("L'été, c'est 3 fois!")).alias("t"), text.sentences(F.lit("A. B? C!D")).alias("s"),
        text.sentence_count(F.lit("A. B? C!D")).alias("n"), text.terms(F.lit("a bb Ccc")).alias("w"),
        text.normalise_line(F.lit("\t x\ny ")).alias("l"),
        text.strip_markup(F.lit(r"{\an8}<i>Hi</i>\Nyou ♪")).alias("m")).first()
    assert row.t == ["l", "'", "été", ",", "c", "'", "est", "3", "fois", "!"]
    assert row.s == ["A.", "B?", "C!D"] and row.n == 3
    assert row.w == ["bb", "ccc"]
    assert row.l == "x y"
    assert row.m.strip() == "Hi you"


def test_split_documents_numbers_lines(spark):
    docs = spark.createDataFrame([(7, "a\n\nb")], "doc_id bigint, text string")
    assert [(r.pos, r.line) for r in lines.lines(lines.split_documents(docs)).collect()] == [(0, "a"), (2, "b")]


def test_tokens_of_any_script(spark):
    rows = [("Quoi ? Non", 3), ("été", 1), ("नमस्ते दुनिया", 2), ("一　二", 2), ("a b\x0bc", 3), (" ", 0)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "line string")
    assert [r[0] for r in df.select(text.token_count(F.col("line"))).collect()] == [n for _, n in rows]
    breaks = spark.createDataFrame([("One. Two!　Three",)], "line string")
    assert breaks.select(text.sentence_count(F.col("line"))).first()[0] == 3
    assert len(breaks.select(text.sentences(F.col("line"))).first()[0]) == 3
