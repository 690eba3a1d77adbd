import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cuesheet.functions import naming
from cuesheet.operators import encoding, evaluation, merging, selection
from cuesheet.sources import tables


def test_target_cleaning_counts_what_it_drops(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (10.0, 1), (10.1, 1), (None, 1), (5.0, None)], "rating double, votes int")
    seen = Observation()
    kept = selection.clean_target(df, dropped=seen)
    assert sorted(r.rating for r in kept.collect()) == [1.0, 10.0]
    assert seen.get["dropped"] == 2


def test_filters(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, subtitles_exists boolean")
    assert [r.id for r in selection.with_subtitles(df).collect()] == [1]
    names = spark.createDataFrame([("S1_metadata.json",), ("S123_metadata.json",), ("xS1_metadata.json",)], "name string")
    assert [r.name for r in selection.season_metadata_files(names).collect()] == ["S1_metadata.json"]
    status = spark.createDataFrame([("ok",), ("NSF",), ("N/A",), ("ok",), (None,)], "s string")
    assert {r.s: r.n for r in selection.status_counts(selection.skip_status(status, "s"), "s").collect()} == {"ok": 2, None: 1}
    assert selection.substring_exists(names, "name", "123").first().found
    assert not selection.substring_exists(names, "name", "none").first().found
    shows = spark.createDataFrame([("S1_metadata.json",), ("gone",)], "show string")
    assert selection.shows_with_folder(shows, names, "show", "name").count() == 1


@pytest.mark.parametrize("name, code", [
    ("1883 S01E05.srt", (1, 5)), ("Seinfeld.S02E02.The.Pony.Remark.DVDRip.x264-DiGG.srt", (2, 2)),
    ("Adventure Time S09 E01 Orb.srt", (None, None)), ("x.s00e00.zip", (1, 1)), ("a S01E02 S03E04.srt", (1, 2))])
def test_episode_codes(spark, name, code):
    row = spark.range(1).select(naming.season_number(F.lit(name)), naming.episode_number(F.lit(name))).first()
    assert tuple(row) == code


@pytest.mark.parametrize("title, episode, want", [
    ("Show S01E05", 5, True), ("Show E5", 5, False), ("Show E12", 12, True), ("Show E12", 1, False), ("Show E120", 12, False)])
def test_title_codes(spark, title, episode, want):
    assert spark.range(1).select(naming.title_has_episode(F.lit(title), F.lit(episode))).first()[0] is want


def test_names_and_ids(spark):
    row = spark.range(1).select(
        naming.sanitise(F.lit('a<b>c:"d/e\\f|g?h*')), naming.numeric_id(F.lit("tt0012345")), naming.numeric_id(F.lit("ttx")),
        naming.archive_name(F.lit("My Show"), F.lit(1), F.lit(2)), naming.decoded_path(F.lit("a%20b+c"))).first()
    assert tuple(row) == ("a_b_c__d_e_f_g_h_", 12345, None, "My_ShowS1E2.zip", "a b+c")


def test_encoders(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["c", "b"]), (3, None)], "id int, tfidf_keywords array<string>")
    vocabulary = encoding.keyword_vocabulary(df, max_vocab_size=2)
    assert vocabulary == ["a", "b"]
    hot = encoding.multi_hot(df, vocabulary)
    assert hot.columns == ["id", "kw_a", "kw_b"]
    assert [tuple(r)[1:] for r in hot.orderBy("id").collect()] == [(1, 1), (1, 0), (0, 1), (0, 0)]

    fixed = spark.createDataFrame([(0, [.1, .2, .7]), (1, [.5]), (2, None)], "id int, t array<double>")
    assert [tuple(r)[1:] for r in encoding.expand_fixed(fixed, "t", "topic", 3).orderBy("id").collect()] == [
        (.1, .2, .7), (0, 0, 0), (0, 0, 0)]
    assert [tuple(r)[1:] for r in encoding.expand_list(fixed, "t", "x").orderBy("id").collect()] == [
        (.1, .2, .7), (.5, None, None), (None, None, None)]

    maps = spark.createDataFrame([(0, {"noun": .2}), (1, {"noun": .1, "verb": .3})], "id int, pos map<string,double>")
    wide = encoding.expand_dict(maps, "pos", "pos")
    assert wide.columns == ["id", "pos_noun", "pos_verb"]
    assert [tuple(r)[1:] for r in wide.orderBy("id").collect()] == [(.2, None), (.1, .3)]


def test_categories(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "id int, c string")
    assert [r.c for r in encoding.ordinal_encode(df, "c").orderBy("id").collect()] == [1, 0, -1, 1]
    assert encoding.cardinalities(df, ["c"]) == {"c": 2}
    assert encoding.split_by_type(df) == (["c"], ["id"])
    hot = encoding.one_hot(spark.createDataFrame([("r",), ("q",)], "c string"), "c", ["p", "q"])
    assert [tuple(r) for r in hot.collect()] == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        encoding.fit_categories(df, "c", 1)
    tie = spark.createDataFrame([("y",), ("x",), (None,)], "c string")
    assert sorted(r.c for r in encoding.impute_mode(tie, ["c"]).collect()) == ["x", "x", "y"]


def test_literals_of_old_files(spark):
    row = spark.range(1).select(
        encoding.parse_list(F.lit("['a', 'b']")), encoding.parse_list(F.lit("oops")), encoding.parse_list(F.lit(None).cast("string")),
        encoding.parse_dict(F.lit("{'noun': 0.5}")), encoding.parse_dict(F.lit("["))).first()
    assert tuple(row) == (["a", "b"], [], [], {"noun": 0.5}, {})


def test_merge_keeps_labels_of_metadata(spark):
    meta = spark.createDataFrame([(1, 8.0, 10, "s", 5)], "imdbID bigint, rating double, votes int, tv_show_name string, line_count int")
    feats = spark.createDataFrame([("tt0001", 0.0, 0, 7), ("tt2", 0.0, 0, 9)], "imdbID string, rating double, votes int, line_count int")
    row = merging.merge_features(meta, feats, group="tv_show_name").first().asDict()
    assert row == {"imdbID": 1, "rating": 8.0, "votes": 10, "tv_show_name": "s", "line_count_imdb": 5, "line_count_sub": 7}
    assert selection.drop_present(meta).columns == ["votes", "tv_show_name", "line_count"]


def test_upsert_and_worklist(spark):
    episodes = spark.createDataFrame([(1, e, False, "") for e in (1, 2, 3)],
                                     "season int, episode int, subtitles_exists boolean, subtitles_full_path string")
    names = spark.createDataFrame([("x.S00E00.zip",), ("y.S01E02.zip",), ("no code.zip",), ("z.S09E09.zip",)], "path string")
    listing = names.select("path", naming.season_number(F.col("path")).alias("season"), naming.episode_number(F.col("path")).alias("episode"))
    done = merging.upsert_listing(episodes, listing, ["season", "episode"])
    got = {r.episode: (r.subtitles_exists, r.subtitles_full_path) for r in done.collect()}
    assert got == {1: (True, "x.S00E00.zip"), 2: (True, "y.S01E02.zip"), 3: (False, "")}
    assert [r.episode for r in merging.missing_worklist(done).collect()] == [3]
    cases = [(1, 1, None, None), (1, 2, None, ""), (1, 3, False, None), (1, 4, False, "p"), (1, 5, True, ""), (1, 6, True, "p"), (1, 7, True, None)]
    wanted = merging.missing_worklist(spark.createDataFrame(cases, episodes.schema)).collect()
    assert sorted(r.episode for r in wanted) == [3, 4, 5]


def test_append_and_lookup(spark):
    old, new = spark.createDataFrame([(1, 2)], "id int, a int"), spark.createDataFrame([(2, 3)], "id int, b int")
    assert sorted(merging.append_rows(old, new).collect(), key=lambda r: r.id)[1].asDict() == {"id": 2, "a": None, "b": 3}
    got = {r.id: r.missing for r in merging.lookup_ids(spark.range(3).withColumnRenamed("id", "id"), old, "id").collect()}
    assert got == {0: True, 1: False, 2: True}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 3.0), (0, 3.0, 4.0)], "fold int, y double, p double")
    m = evaluation.regression_metrics(df, "y", "p")
    assert tuple(m.first())[2:] == pytest.approx((1.0, 1.0, -0.5, 1.0))
    both = m.unionByName(m.withColumn("rmse", F.lit(3.0)))
    assert {r.metric: (r["mean"], r["std"]) for r in evaluation.cv_summary(both).collect()}["rmse"] == (2.0, 1.0)


def test_feature_csv_import_and_round_trip(spark, tmp_path):
    body = ('﻿imdbID,rating,tfidf_keywords,pos_distribution,topic_distribution\n'
            'tt1,8.5,"[\'a\', \'b\']","{\'noun\': 0.5}","[0.2, 0.8]"\ntt2,,"bad","",""\n')
    (tmp_path / "f.csv").write_text(body, encoding="utf-8")
    df = tables.read_feature_csv(spark, str(tmp_path / "f.csv"))
    rows = {r.imdbID: r for r in df.collect()}
    assert rows["tt1"].tfidf_keywords == ["a", "b"] and rows["tt1"].pos_distribution == {"noun": 0.5}
    assert rows["tt1"].topic_distribution == [0.2, 0.8] and rows["tt2"].tfidf_keywords == [] and rows["tt2"].rating is None
    tables.write_features(df, str(tmp_path / "out"))
    back = tables.read_if_exists(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tables.read_if_exists(spark, str(tmp_path / "none"), "a int").count() == 0
    tables.write_log(df.select("imdbID", "rating"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
