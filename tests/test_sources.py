import io
import json
import zipfile

import pytest

from cuesheet.plans import features
from cuesheet.sources import corpus, lexicons, metadata, pages
from cuesheet.streaming import ingest

SRT = """1
00:00:01,000 --> 00:00:03,500
<i>Run</i> away!

2
00:00:05,000 --> 00:00:07,000
Why?
42

3
00:00:10,000 --> 00:00:11,000

note without a time

5
00:00:25,000 --> 00:02:10,000
Œuf
"""
ASS = """[Script Info]
Title: x

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.50,0:00:02.05,Default,,0,0,0,,{\\i1}Hi, you\\Nthere
Comment: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,a note
Dialogue: broken
"""


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, content string")


def parsed(df):
    return [(r.start_ms, r.end_ms, r.text.strip()) for r in df.orderBy("doc_id", "pos").collect()]


def test_srt_blocks(spark):
    want = [(1000, 3500, "<i>Run</i> away!"), (5000, 7000, "Why?\n42"), (10000, 11000, ""), (25000, 130000, "Œuf")]
    assert parsed(corpus.read_cues(files(spark, ("a.srt", SRT)))) == want
    windows = "﻿" + SRT.replace("\n", "\r\n")
    assert parsed(corpus.read_cues(files(spark, ("a.srt", windows)))) == want
    assert parsed(corpus.read_cues(files(spark, ("a.srt", "00:00:01,000 --> 00:00:02,000\nno number")))) == [(1000, 2000, "no number")]


def test_ass_events(spark):
    assert parsed(corpus.read_cues(files(spark, ("a.ass", ASS)))) == [
        (1500, 2050, "{\\i1}Hi, you\\Nthere"), (3000, 4000, "a note")]


def test_rejected_files(spark):
    f = files(spark, ("a.srt", SRT), ("b.srt", ASS), ("c.txt", SRT), ("d.srt", ""))
    bad = {r.doc_id: r.reason for r in corpus.rejects(f, corpus.read_cues(f)).collect()}
    assert set(bad) == {"b.srt", "c.txt", "d.srt"}


@pytest.fixture
def tree(tmp_path):
    """A show with a zipped episode, a plain one, one without file, one not marked and one that cannot be parsed."""
    subs, meta = tmp_path / "My Show" / "Subtitles" / "S1", tmp_path / "My Show" / "Metadata"
    subs.mkdir(parents=True)
    meta.mkdir()
    with zipfile.ZipFile(subs / "My_Show.S01E01.zip", "w") as z:
        z.writestr("inner.S01E01.srt", SRT)
        z.writestr("second.srt", "x")
    (subs / "My Show S01E02.srt").write_text(SRT.replace("Run", "Walk"), encoding="utf-8")
    (subs / "My Show S01E05.srt").write_text("nothing", encoding="utf-8")
    (subs / "bad.zip").write_bytes(b"not a zip")
    (subs / "bad2.zip").write_bytes(b"not a zip either")
    buffer = io.BytesIO()
    zipfile.ZipFile(buffer, "w").close()
    (subs / "empty.zip").write_bytes(buffer.getvalue())
    entry = {"imdb_id": "tt1", "subtitles_exists": True, "subtitles_full_path": str(subs / "My_Show.S01E01.zip"), "rating": 8.1, "votes": 12}
    season = {
        "1": entry,
        "2": {**entry, "imdb_id": "tt2", "subtitles_full_path": str(subs / "My Show S01E02.srt"), "rating": None},
        "3": {**entry, "imdb_id": "tt3", "subtitles_full_path": str(subs / "gone.zip")},
        "4": {"imdb_id": "tt4", "subtitles_exists": False},
        "5": {**entry, "imdb_id": "tt5", "subtitles_full_path": str(subs / "My Show S01E05.srt")},
        "6": {**entry, "imdb_id": "tt6", "subtitles_full_path": "hdfs://name:8020" + str(subs / "bad2.zip")},
    }
    (meta / "S1_metadata.json").write_text(json.dumps(season, indent=4))
    (meta / "other.json").write_text("{}")
    return tmp_path


def test_discovery_and_metadata(spark, tree):
    found = {r.name: (r.show, r.season, r.episode) for r in corpus.read_files(spark, str(tree)).collect()}
    assert found["My Show S01E02.srt"] == ("My Show", 1, 2)
    rows = {r.episode: r for r in metadata.read_season_metadata(spark, str(tree)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6} and rows[1].show == "My Show" and rows[1].season == 1
    assert rows[1].votes == 12 and rows[2].rating is None and rows[4].subtitles_exists is False
    text = metadata.to_season_json(metadata.read_season_metadata(spark, str(tree))).first().json
    assert json.loads(text)["1"]["imdb_id"] == "tt1"


def test_archives(spark, tree):
    members = corpus.expand_archives(spark, str(tree)).collect()
    assert sorted(m.member for m in members if m.member) == ["inner.S01E01.srt", "second.srt"]
    assert {m.path.rsplit("/", 1)[1] for m in members if m.reason} == {"bad.zip", "bad2.zip", "empty.zip"}
    first = corpus.first_members(corpus.expand_archives(spark, str(tree))).collect()
    assert [(f.name, f.season, f.episode) for f in first] == [("inner.S01E01.srt", 1, 1)]


def test_corpus_job_adds_each_episode_once(spark, tree, tmp_path):
    out = str(tmp_path / "features")
    for _ in range(2):  # the second run finds everything done
        table, bad = features.corpus_features(spark, str(tree), out, features.Resources(cluster_rounds=2))
        rows = {r.imdbID: r for r in table.collect()}
        assert set(rows) == {"tt1", "tt2"} and table.count() == 2
    assert table.columns == [*features.FEATURE_COLUMNS, *features.LABEL_COLUMNS]
    reasons = {r.doc_id.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert set(reasons) == {"gone.zip", "bad2.zip", "My Show S01E05.srt"} and "exist" in reasons["gone.zip"] and "archive" in reasons["bad2.zip"]
    one = rows["tt1"]
    assert (one.line_count, one.duration_seconds, one.rating, one.votes) == (3, 130.0, 8.1, 12) and rows["tt2"].rating == 0.0
    assert one.num_clusters == 3 and sum(one.topic_distribution) == pytest.approx(1.0)
    assert "away" in one.tfidf_keywords and one.semantic_variance is None


def test_single_file(spark, tree):
    path = tree / "My Show" / "Subtitles" / "S1"
    wanted = features.Resources(cluster_rounds=1)
    one = features.single_file_features(spark, str(path / "My Show S01E02.srt"), wanted)
    grouped = features.grouped_features(one)
    assert grouped.first().linguistic_features.line_count == 3
    assert features.flat_features(grouped).columns == one.columns
    assert features.single_file_features(spark, str(path / "My Show S01E05.srt"), wanted).count() == 0


def test_ingestion_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    base, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    base.mkdir()

    def counted(batch):
        return features.document_features(corpus.read_cues(batch), wanted=("line_count", "word_count"))

    for step in range(2):
        (base / f"e{step}.srt").write_text(SRT.replace("away", "away " * (step + 1)), encoding="utf-8")
        for _ in range(2):
            ingest.ingest(ingest.stream_files(spark, str(base)), counted, out, progress)
        got = {r.doc_id.rsplit("/", 1)[1]: (r.line_count, r.word_count) for r in spark.read.parquet(out).collect()}
        batch = features.document_features(corpus.read_cues(corpus.read_files(spark, str(base))), wanted=("line_count", "word_count"))
        assert got == {r.doc_id.rsplit("/", 1)[1]: (r.line_count, r.word_count) for r in batch.collect()}
        assert spark.read.parquet(out).count() == step + 1


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("kill\tanger\t1\nkill\tjoy\t0\n\n")
    assert lexicons.read_lexicon(spark, str(tmp_path / "lex.txt")).count() == 2
    assert lexicons.read_lexicon(spark, str(tmp_path / "none.txt")).count() == 0


def test_listing_pages(spark):
    html = '<h2 class="x">No subtitles found</h2><ul><li a="1"><a class="k" href="/one"><b>One</b></a></li><li>plain</li></ul>'
    df = spark.createDataFrame([(1, html), (2, "<p>")], "page_id int, html string")
    assert [tuple(r) for r in pages.item_links(df).orderBy("pos").collect()] == [(1, 0, "/one", "One"), (1, 1, "", "plain")]
    got = {r.page_id: r for r in pages.page_summary(df).collect()}
    assert (got[1].first_href, got[1].links, got[1].items, got[1].heading, got[1].no_result) == ("/one", 1, 2, "No subtitles found", True)
    assert got[2].first_href == "N/A" and not got[2].no_result


def test_nested_items_quotes_and_references(spark):
    html = """<!-- <li>no</li> --><ul class='all list'><li class="x big"><a title="a > b" href="/o'brien?a=1&amp;b=2">O&#39;Brien &amp;lt; &#x1F600;</a>
<ul><li><a href='/in"ner'>Inner</a></li><li>plain</li></ul></li><LI><h4>Head</h4><a data-href="/no" href=/bare>x</a></LI></ul>
<script>var s = "<li><a href='/js'>js</a></li>";</script><li>open<a name="here">"""
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in pages.item_links(df).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "/o'brien?a=1&b=2", "O'Brien &lt; \U0001F600\nInnerplain"), (1, 1, '/in"ner', "Inner"), (1, 2, "", "plain"),
                   (1, 3, "/bare", "Head"), (1, 4, "", "open")]
    assert [r.href for r in pages.item_links(df, classes="big x").collect()] == ["/o'brien?a=1&b=2"]
    summary = {r.page_id: r for r in pages.page_summary(df).collect()}
    assert (summary[1].first_href, summary[1].links, summary[1].items) == ("/o'brien?a=1&b=2", 3, 5) and summary[3].first_href == "N/A"


def test_links_of_one_block(spark):
    html = '<div class="a"><a href="/1">1</a></div><div class="flex b"><div><a href="/2">2</a></div><a href="/3">3</a><a href="">e</a></div><a href="/4">4</a>'
    df = spark.createDataFrame([(1, html), (2, "<p>")], "page_id int, html string")
    got = {r.page_id: (r.found, r.n_links, r.links) for r in pages.block_links(df, "div", "b flex").collect()}
    assert got == {1: (True, 2, ["/2", "/3"]), 2: (False, 0, [])}


def test_a_page_of_many_items(spark):
    html = "<ul>" + "".join(f'<li><a href="/{i}">{i}</a></li>' for i in range(3_000)) + "</ul>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert {r.href for r in pages.item_links(df).collect()} == {f"/{i}" for i in range(3_000)}
