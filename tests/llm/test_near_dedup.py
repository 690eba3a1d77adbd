import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cuesheet.llm import components as C
from cuesheet.llm import near_dedup as N
from cuesheet.llm import shingles as S

SCHEMA = "doc_id bigint, text string, kept string, node int"


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 10 ** 9), r[0])
    return sorted((r[0], len(sets[i]), least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


def corpus(seed, n):
    """Copies, near copies at all distances, short texts and unrelated ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.choice([3, 5, 6, 12, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(text), "x", 1))
    return rows


@pytest.mark.parametrize("rows_in_task", [512, 5])
def test_components_equal_brute_force(spark, monkeypatch, rows_in_task):
    """Also where nearly every cluster is large and its parts meet on rare shingles."""
    monkeypatch.setattr(N, "CLUSTER_ROWS", rows_in_task)
    monkeypatch.setattr(N, "ENTRIES_PER_SALT", 20)
    rows = corpus(3, 240) + [(1000, None, "", 0), (1001, "", "", 0), (1002, " \n", "", 0), (1003, "One", "", 0), (1004, "one", "", 0),
                             (1005, "É é", "", 0), (1006, "long " * 50_000, "", 0), (1007, "LONG\t" * 50_000, "", 0)]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_short_sets_at_the_border_are_never_ruled_out():
    """3 of 4 shingles in common, 6 of 8, and just below."""
    r = random.Random(2)
    rng = np.random.default_rng(2)
    for _ in range(5_000):
        both, more = r.choice([(3, 1), (6, 2), (9, 3), (30, 10), (29, 11)])
        hashes = rng.integers(0, 1 << 63, both + more, dtype=np.uint64) * np.uint64(2)
        assert bool(N.linked_pairs([np.sort(hashes), np.sort(hashes[:both])])) == (both * 4 >= (both + more) * 3)


def test_texts_that_share_one_passage_and_a_tight_group(spark):
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(2_000):
        own = [f"t{r.randrange(10**9)}" for _ in range(70)]
        rows.append((i, " ".join(own[:35] + passage + own[35:]), "", 0))
        if i % 100 == 0:  # a true partner of every hundredth
            rows.append((10_000 + i, " ".join(own[:35] + passage + own[35:60]), "", 0))
    base = [f"g{i}" for i in range(150)] + passage
    for i in range(900):
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 5])):
            text[r.randrange(150)] = f"e{r.randrange(10**9)}"
        rows.append((20_000 + i, " ".join(text), "", 0))
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: brute_set(t) for i, t, *_ in rows}
    holders = {}
    for i, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():  # partners share a shingle that no other group has
        rare = {j for h in s if len(holders[h]) < 1_000 for j in holders[h] if j < i}
        for j in rare:
            if root(i) != root(j) and 4 * len(s & sets[j]) >= 3 * len(s | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in sets}


def test_repeated_rows_and_null_ids(spark):
    got = N.near_duplicates(spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, "a b", "", 0), (None, "z", "", 0), (2, "other", "", 0)], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 2, True)], key=str)
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_follow_the_words_and_not_the_batch(monkeypatch):
    texts = ["a b c d e f", None, "", "A  B\tc\nd e F", "x", "ab" * 3000 + " y z", "no-break space one two three four"]
    whole = [s.tolist() for s in S.shingle_sets(pa.array(texts))]
    assert whole[0] == whole[3] and [len(s) for s in whole] == [len(brute_set(t)) for t in texts]
    assert [s.tolist() for t in texts for s in S.shingle_sets(pa.array([t], pa.string()))] == whole
    monkeypatch.setattr(S, "SLICE", 50)
    assert [len(s) for s in S.shingle_sets(pa.array(texts))] == [len(s) for s in whole]


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
        n = int(2000 * share)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:n], pool[2000:4000 - n]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(N.estimate(N.registers(a), N.registers(b)) - true) < 0.16


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200), (200, 250)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 250: 200, 300: 200}


def test_one_row_of_each_group_with_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", 1, "p"), (2, "a b c d e f", "y", 2, "q"), (3, None, "z", 3, "r"), (3, None, "z", 3, "r"), (4, "other", "w", 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _gone int, _twice string")
    got = N.one_of_each_group(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    assert N.one_of_each_group(docs.limit(0)).count() == 0


def test_linked_sets_meet_on_the_first_quarters_of_their_rows_alone(spark):
    """Only leading shingles become rows, also where all shingles share 16 slots; no linked pair of two parts is lost."""
    r = random.Random(5)
    common = [r.getrandbits(63) for _ in range(200)]
    sets = [np.array(sorted(r.sample(common, r.choice([40, 120, 170])) + [r.getrandbits(63) for _ in range(r.choice([0, 5, 30]))]), np.uint64)
            for _ in range(120)]
    parts = spark.createDataFrame([(i, 7, i % 3, i % 5, len(s), s.tobytes()) for i, s in enumerate(sets)],
                                  "node bigint, cluster bigint, block bigint, part bigint, n_shingles bigint, set binary").repartition(3)
    linked = {(a, b) for a, b in N.linked_pairs(sets) if a % 5 != b % 5}
    assert linked
    for slots in (16, 1 << 16):
        counts = N.shingle_counts(parts, slots)
        assert counts.sum() == sum(map(len, sets))
        assert N.leading_shingles(parts, counts).count() <= sum(len(s) - -(-len(s) * 3 // 4) + 1 for s in sets)
        met = {tuple(sorted((p["u"], p["v"]))) for p in N.rare_meetings(parts, counts).collect()}
        assert linked <= met and all(a % 5 != b % 5 for a, b in met)
    pairs = N.rare_meetings(parts, counts)
    found = {tuple(sorted(p)) for p in N._links_in_cells(pairs, parts).collect()}
    alike = dict(enumerate(range(len(sets))))
    for a, b in N._spanning(N.linked_pairs(sets), len(sets)):
        alike = {k: alike[b] if v == alike[a] else v for k, v in alike.items()}
    assert found and all(alike[a] == alike[b] for a, b in found)
