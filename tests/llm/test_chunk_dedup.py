import hashlib
import random

import numpy as np
import pytest

from cuesheet.llm import chunk_dedup

SCHEMA = "doc_id bigint, text string, recipe string, kept int"


def lower(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault(lower(text), []).append((-1 if doc_id is None else doc_id, i, doc_id))
    out = []
    for text, members in groups.items():
        last = max(members)
        out += [(m[2], last[2], len(members), hashlib.sha256(text).hexdigest()) for m in members]
    return sorted(out, key=str)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "Gamma", "été", "delta"]) + str(r.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_groups_equal_brute_force(spark, id_bytes):
    """With one byte per digest nearly all chunks clash, and the ordinals must tell them apart."""
    long = words(1, 4000)
    rows = [(i, words(i % 7, 300 + i % 3)) for i in range(40)]
    rows += [(100, long), (101, long.upper()), (102, long.replace("alpha", "ALPHA")), (103, long[:-1]), (104, "x" + long),
             (105, None), (106, ""), (107, "É"), (108, "é"), (None, long), (109, "a"), (109, "A")]
    rows = [(*r, "clash", 3) for r in rows]
    got = chunk_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), id_bytes).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(kept) == 1 for kept in groups.values())  # also of the row that is there twice


def test_cuts_follow_content(spark):
    data = np.frombuffer(words(5, 30_000).encode(), np.uint8)
    points = chunk_dedup.cut_points(data)
    ends = chunk_dedup.chunk_ends(points, 0, len(data))
    assert ends[-1] == len(data) and 500 < np.mean(np.diff([0, *ends])) < 6000
    shifted = np.concatenate([np.full(1000, 65, np.uint8), data])
    other = {e - 1000 for e in chunk_dedup.chunk_ends(chunk_dedup.cut_points(shifted), 0, len(shifted))}
    assert len(other & set(ends)) > 0.9 * len(ends)


def test_slices_do_not_move_the_cuts(monkeypatch):
    data = np.frombuffer(words(6, 3000).encode(), np.uint8)
    whole = chunk_dedup.cut_points(data).tolist()
    monkeypatch.setattr(chunk_dedup, "SLICE", 1000)
    sliced = chunk_dedup.cut_points(data).tolist()
    assert [p for p in sliced if p > 32] == [p for p in whole if p > 32]


def test_no_rows(spark):
    assert chunk_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
