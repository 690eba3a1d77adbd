import hashlib
import random

import numpy as np
import pytest
import zstandard

from cuesheet.llm import suffix_repeats as R

SCHEMA = "doc_id bigint, text string, key string, sha int"


def brute(rows):
    """The definition read literally: the smallest document of every 50-byte string, then the bytes that it covers."""
    least = {}
    texts = [(-1 if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            s = b[i:i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for (d, b), row in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((row[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, alphabet="abcdefgh é"):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [make(k) for k in (49, 50, 51, 52, 60, 75, 76, 77, 120, 400)]
    rows = []
    for i in range(n):
        text = make(r.randrange(0, 120))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, 10)
            text += (p[a:] if r.random() < 0.5 else p[:len(p) - a]) + make(r.choice([0, 1, 2, 30, 90]))
        rows.append((i, text, "x", 1))
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "flush"), [(1, "abcdefgh é", 1 << 22), (2, "ab", 3000), (3, "a", 1 << 22)])
def test_rows_equal_the_definition(spark, monkeypatch, seed, alphabet, flush):
    monkeypatch.setattr(R, "TEXT_AT_ONCE", flush)
    rows = corpus(seed, 80, alphabet)
    rows += [(200, rows[5][1], "", 0), (201, rows[5][1], "", 0), (202, None, "", 0), (203, "", "", 0), (204, "short", "", 0), (205, "short", "", 0),
             (206, "z" * 3000, "", 0), (207, "z" * 1000 + "q" + "z" * 49, "", 0), (208, "ñ" * 40, "", 0), (209, "xñ" * 40, "", 0), (7, rows[7][1], "", 0),
             (None, rows[9][1], "", 0), (9, rows[3][1] + rows[9][1], "", 0)]
    got = R.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_every_window_holds_an_anchor_that_its_bytes_decide(monkeypatch):
    data = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)
    places, hashes = R.anchors(data)
    assert all(((places >= i) & (places <= i + R.OFFSETS)).any() for i in range(len(data) - 49))
    assert len(places) < 0.09 * len(data)
    for size in (700, 990, 4960):
        monkeypatch.setattr(R, "SLICE", size)
        again, same = R.anchors(data)
        assert dict(zip(again.tolist(), same.tolist(), strict=True)) == dict(zip(places.tolist(), hashes.tolist(), strict=True))


def test_intervals_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        common = np.concatenate([[0], rng.integers(0, 8, 30)])
        want = set()
        for length in range(3, 9):
            i = 0
            while i < len(common):
                j = i
                while j + 1 < len(common) and common[j + 1] >= length:
                    j += 1
                if j > i and common[i + 1:j + 1].min() == length:
                    outer = max(common[i] if i else 0, common[j + 1] if j + 1 < len(common) else 0, 2)
                    want.add((i, j, length, outer))
                i = j + 1
        assert set(R.prefix_intervals(common, 3)) == want


def test_all_occurrences_of_a_repeat_come_out():
    body = np.frombuffer(random.Random(3).randbytes(50), np.uint8)
    texts = [np.concatenate([np.frombuffer(random.Random(10 + i).randbytes(30), np.uint8), body]) for i in range(6)]
    places = [R.anchors(t) for t in texts]
    rows, before, after = [], [], []
    for t, (p, _) in zip(texts, places, strict=True):
        inside = p[p >= 30]
        rows.append(R.contexts(t, inside[:1]))
        before.append(min(int(inside[0]), R.OFFSETS))
        after.append(min(len(t) - int(inside[0]), 50))
    groups = [len(m) for _, m, g in R.repeats(np.concatenate(rows), np.array(before), np.array(after)) for m in [m[g == v] for v in set(g.tolist())]]
    assert max(groups) == 6


def test_no_rows(spark):
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("seed", "alphabet", "flush", "hot"), [(1, "abcdefgh é", 1 << 22, 2), (2, "ab", 3000, 3), (4, "abcdefgh é", 1000, 5), (5, "a", 3000, 2)])
def test_rows_are_the_same_when_hot_anchors_are_dealt_out(spark, monkeypatch, seed, alphabet, flush, hot):
    monkeypatch.setattr(R, "TEXT_AT_ONCE", flush)
    rows = corpus(seed, 80, alphabet)
    rows += [(7, rows[7][1], "", 0), (None, rows[9][1], "", 0), (9, rows[3][1] + rows[9][1], "", 0), (206, "z" * 3000, "", 0), (207, "z" * 1000 + "q" + "z" * 49, "", 0)]
    got = R.remove_repeats(spark.createDataFrame(rows, SCHEMA), hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_no_anchor_of_a_common_passage_gathers_its_documents(spark):
    r = random.Random(8)
    make = lambda k: "".join(r.choice("abcdefghijklmnop ") for _ in range(k))
    passage = make(120)
    rows = [(i, make(100) + passage + make(100), "", 0) for i in range(300)]
    texts = spark.createDataFrame(rows, SCHEMA).select(*R.text_key(), "text").repartition(3).cache()
    shared = R.shared_anchors(texts, 16, 100).cache()
    hot = R.hot_anchors(shared)
    held = [R.anchor_codes(np.frombuffer(x["low"], np.uint32), x["bucket"]) for x in shared.where("not hot").collect()]
    codes, count = np.unique(np.concatenate(held), return_counts=True)
    assert set(hot.tolist()) == set(codes[count >= 100].tolist()) and len(hot) and count.max() == 300
    found = R.occurrences(texts, shared, 16, hot).collect()
    cold = np.concatenate([np.frombuffer(zstandard.decompress(x["rows"]), np.uint8).reshape(-1, R.CONTEXT) for x in found if 0 <= x["bucket"] < 16])
    assert np.unique(cold[:, R.OFFSETS:R.OFFSETS + R.SEED], axis=0, return_counts=True)[1].max() < 100
    by_digest = [d for x in found if x["bucket"] >= 16 for d in {bytes(x["digests"][i:i + 16]) for i in range(0, len(x["digests"]), 16)}]
    assert max(by_digest.count(d) for d in by_digest[:500]) <= 3  # one per flush


def test_anchors_send_two_entries_per_flush(spark, monkeypatch):
    """What goes to an anchor's bucket does not grow with its documents."""
    sent = []
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *c: sent.append(self) or _Nothing())
    texts = spark.createDataFrame([(i, "the same passage in all of the documents, " * 3 + str(i), "", 0) for i in range(400)], SCHEMA).select(*R.text_key(), "text").coalesce(1)
    R.shared_anchors(texts, 16)
    assert max(len(x["low"]) // 4 for x in sent[0].where("bucket >= 0").collect()) < 400


class _Nothing:
    def applyInArrow(self, *_):  # noqa: N802
        return None
