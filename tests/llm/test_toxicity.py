import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import toxicity as T

SCHEMA = "doc_id bigint, text string, score string, toxic int"
WORDS = "harbour lantern meadow copper winter quiet orchard ribbon stone marble velvet thunder river window garden silver".split()


def invented(n, seed=1):
    """Half of the texts hold one of two bad stems with an ending of its own."""
    r = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = r.choice(WORDS, 30).tolist()
        if i % 2:
            words.insert(5, "grimbol" + r.choice(["ka", "to", "re", "ni", "su"]))
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, labels = invented(400)
    return T.train([T.bag(t) for t in texts], labels)


def test_unseen_spellings_share_ngrams(model):
    clean, bad, short = model.scores(["harbour lantern meadow copper " * 5, "harbour lantern grimbolxyz copper " * 2, "grimbolqq"])
    assert clean < 0.3 < 0.7 < bad and short > clean


def test_scores_equal_a_plain_sum(model):
    texts = ["Grimbolka, lantern! lantern", "x", "Straße ÉTÉ 123 grimbol", "a " * 50]
    for text, got in zip(texts, model.scores(texts), strict=True):
        top = low = 0.0
        counts = {}
        for w in text.lower().split():
            counts[w] = counts.get(w, 0) + 1
        codes = "".join(map(chr, T.characters(" " + " ".join(counts) + " ")))
        weights = [1 + np.log(c) for w, c in counts.items() for _ in range(len(w) + 1)]
        for n in T.SIZES:
            for i in range(min(len(codes) - n + 1, len(weights))):
                if " " in codes[i + 1:i + n - 1]:
                    continue
                h = 0
                for k, c in enumerate(codes[i:i + n]):
                    h = ord(c) if k == 0 else (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                bucket = ((h ^ (h >> 15)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - T.BUCKET_BITS)
                top += weights[i] * float(model.table[bucket, 0])
                low += weights[i] * float(model.table[bucket, 1])
        assert got == pytest.approx(1 / (1 + np.exp(-(top / (low + T.MASS) + model.bias))), abs=1e-4)


def test_slices_do_not_change_scores(model, monkeypatch):
    texts, _ = invented(30, 7)
    texts += ["", "z" * 5000]
    whole = model.scores(texts)
    monkeypatch.setattr(T, "SLICE", 97)
    assert np.allclose(model.scores(texts), whole, atol=1e-5)


def test_rows(spark):
    texts, labels = invented(300)
    rows = [(i, t, "x", int(y)) for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    rows += [(None, None, "", 1), (None, "", "", None), (1000, "word " * 100_000, "", 5), (7, texts[7], "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = T.toxic_scores(docs, docs.select("doc_id", "toxic", F.lit("t").alias("text"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) > 0.95 * len(known)
    kept = T.without_toxic(docs, T.fit(docs, docs.select("doc_id", "toxic")))
    assert kept.columns == docs.columns and 100 < kept.count() < 220


def test_held_out_rows_never_teach(spark):
    texts, labels = invented(60)
    docs = spark.createDataFrame([(i, t, "x", int(y)) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], SCHEMA)
    turned = docs.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, docs.select("doc_id", "toxic")), T.fit(docs, turned.select("doc_id", "toxic"))
    assert a.bias == b.bias and np.array_equal(a.table, b.table)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "", None)], SCHEMA)
    got = T.toxic_scores(docs, docs.select("doc_id", "toxic")).collect()
    assert got[0]["score"] == pytest.approx(0.5) and got[0]["predicted"] == 0
    assert T.toxic_scores(docs.limit(0), docs.select("doc_id", "toxic").limit(0)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = T.toxic_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    recall = n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0))
    wrong = n.get((0, 1), 0) / (n.get((0, 1), 0) + n[0, 0])
    assert recall > 0.75 and wrong < 0.01  # some of the rows labelled toxic hold no telling word at all


def test_texts_become_python_strings_some_at_a_time():
    """A batch of ten thousand texts was copied into Python whole."""
    class Docs:
        schema, columns = None, ["doc_id", "text"]

        def mapInArrow(self, run, schema):
            return run

    model = T.Model(np.zeros((1 << T.BUCKET_BITS, 2), np.float32), 0.0)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": ["some text", None] * 1000})
    kept = list(T.without_toxic(Docs(), model)(iter([batch])))
    assert max(b.num_rows for b in kept) <= 512
    assert [i for b in kept for i in b.column("doc_id").to_pylist()] == list(range(2000))


def test_bags_travel_packed_and_train_the_same_model():
    """All bags went to the training task at full width, and were held there twice."""
    texts, labels = invented(200)
    bags = [T.bag(t) for t in [*texts, "", "z" * 5000]]
    labels = np.append(labels, [0, 1])
    packed = T.PackedBags([T.pack(b) for b in bags])
    assert sum(map(len, packed.packed)) < 0.7 * sum(6 * len(ids) for ids, _ in bags)
    for (ids, n), (same, m) in zip(bags, packed, strict=True):
        assert np.array_equal(ids, same) and np.array_equal(n.astype(np.float16), m)
    plain = T.train([(ids, n.astype(np.float16)) for ids, n in bags], labels)
    again = T.train(packed, labels)
    assert plain.bias == again.bias and np.array_equal(plain.table, again.table)


def test_scoring_keeps_few_texts_in_python():
    seen = []

    class Spy(T.Model):
        def scores(self, texts):
            seen.append(len(texts))
            return super().scores(texts)

    class Docs:
        schema, columns = None, ["doc_id", "text"]

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": ["some text"] * 600})
    kept = T.without_toxic(Docs(), Spy(np.zeros((1 << T.BUCKET_BITS, 2), np.float32), 0.0))(iter([batch]))
    assert sum(b.num_rows for b in kept) == 600 and max(seen) <= 128
