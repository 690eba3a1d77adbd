"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import importlib
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cuesheet.llm import feistel, mixing, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_near_dedup import brute as near_components  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = [a + b + c for a in ("ba", "ko", "ri", "te", "mu", "sa") for b in ("lin", "dor", "ve", "nak") for c in ("", "s", "ing", "er", "ly")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    items = [(i, prose(r, 30)) for i in range(10)]
    docs, labels = [], []
    for d in range(400):
        text = prose(r, r.choice([20, 80, 200]))
        kind = d % 8
        if kind == 1:
            text = " ".join(w if i % 10 else "grimbol" + r.choice(["ka", "to", "ni"]) for i, w in enumerate(text.split()))
        elif kind == 2 and d > 20:
            text = docs[r.randrange(0, d // 8) * 8][1]
        elif kind == 3 and d > 20:
            words = docs[r.randrange(0, d // 8) * 8][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 4:
            text += " " + r.choice(items)[1] + " " + prose(r, 10)
        docs.append((d, text, "en", "big" if r.random() < 0.6 else r.choice(["a", "b", None]), len(text)))
        if d % 3:
            labels.append((d, 1, int(kind == 1)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "a", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, dict(items)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_each_stage_does_what_a_plain_version_does(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], path).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(t.columns == COLUMNS for t in tables[:5])
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:4]]

    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    plain = dict(zip(texts[0], model.scores([t or "" for t in texts[0].values()]), strict=True))
    assert set(texts[1]) == {d for d, s in plain.items() if s < 0.7}
    bad = {d for d in range(400) if d % 8 == 1}
    assert len(bad & set(texts[1])) <= 2 and len(set(texts[1]) - bad) >= 340

    kept = {d for d, _, _, keep in near_components([(d, t) for d, t in texts[1].items()]) if keep}
    assert set(texts[2]) == kept and len(kept) < len(texts[1]) - 60

    held = set()
    for d, t in texts[2].items():
        words = (t or "").split()
        for item in items.values():
            want = item.split()
            if any(longest_common(want, words[s:s + 38]) >= 0.6 * len(want) and longest_common(want[-6:], words[s:s + 38]) >= 4 for s in range(0, max(len(words) - 30, 1), 4)):
                held.add(d)
    assert set(texts[3]) == set(texts[2]) - held and len(held) > 20

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in tables[3].collect()])
    cursor = con.execute(mixing.plan_sql())
    names = [c[0] for c in cursor.description]
    copies = {row[names.index("doc_id")]: row[names.index("copies")] for row in cursor.fetchall()}
    mixed = [r["doc_id"] for r in tables[4].collect()]
    assert {d: mixed.count(d) for d in set(mixed)} == {d: n for d, n in copies.items() if n}

    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in tables[4].collect()])
    cursor = con.execute(feistel.shard_sql())
    names = [c[0] for c in cursor.description]
    key = lambda r: tuple(str(r[n]) for n in sorted(names))
    assert sorted(map(key, (dict(zip(names, r, strict=True)) for r in cursor.fetchall()))) == sorted(key(r.asDict()) for r in tables[5].collect())


def test_run_is_the_stages_in_order(spark, folder):
    path, rows, _ = folder
    placed = corpus_pipeline.run(spark, path).collect()
    assert {r["law"] for r in placed} == {"rows"} and 100 < len(placed) <= len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    size = np.bincount([r["shard"] for r in placed], minlength=8)
    assert size.max() - size.min() <= 1
    known = {d: t for d, t, *_ in rows}
    assert all(r["text_crc32"] == zlib.crc32((known[r["doc_id"]] or "").encode()) for r in placed)


def test_without_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_has_the_eleven_queries():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
