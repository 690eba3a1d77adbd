"""Toxicity by subword bags.

A text is the weighted mean of the vectors of its character n-grams, and a linear softmax over that mean gives the score.
Vectors and softmax are trained jointly, in numpy, on a bounded sample of labelled rows, in one task; the driver gets the
finished model. A spelling that was never seen still shares n-grams with those that were. Frequent n-grams weigh little, so a few telling words count in a long text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKET_BITS = 20
DIMENSIONS = 4
#: Bound of the training sample: at most so many rows of each class, the first by a hash of the id.
ROWS_PER_CLASS = {1: 1500, 0: 4500}
SEEN = 3  # an n-gram of fewer training rows teaches nothing
RARE = 1e-4  # share of all n-grams at which an n-gram's weight is one half
MASS = 30.0  # weight of an n-gram that says nothing and is in every text: a short text needs more than one odd n-gram
SCALE = 20.0  # the mean is scaled, so that vectors of moderate length can give a clear answer
VISITS, BATCH, RATE = 90_000, 64, 0.05  # each row is seen so often that all are seen VISITS times together, 60 times at most
VECTOR_RATE = 1.0  # plain steps: an n-gram moves in proportion to how often it was wrong, so a rare one hardly does
THRESHOLD = 0.7
SLICE = 1 << 20  # characters worked on at once
TEXTS = 128  # texts copied into Python and scored at once


def _is_letter() -> np.ndarray:
    ascii_table = np.zeros(128, bool)
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        ascii_table[ord(a):ord(b) + 1] = True
    return ascii_table


_ASCII = _is_letter()


def characters(text: str) -> np.ndarray:
    """Code points in lower case; whatever is no letter or digit becomes a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 128
    letter = np.where(low, _ASCII[np.where(low, codes, 0)], (codes > 0xBF) & ~((codes >= 0x2000) & (codes < 0x2070)) & ~((codes >= 0x3000) & (codes < 0x3040)))
    return np.where(letter, codes, np.uint32(32))


def grams(codes: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """For each size, the bucket of the n-gram that starts at each of the first ``count`` codes.

    An n-gram with a space inside, or one that the codes cut off, has the number after the last bucket.
    """
    none = np.uint32(1 << BUCKET_BITS)
    h, gap = codes.copy(), codes == 32
    broken = np.zeros(len(codes), bool)
    for n in range(2, min(SIZES[-1], len(codes)) + 1):
        h = h[:-1] * np.uint32(0x01000193)
        h += codes[n - 1:]
        broken = broken[:-1] | gap[n - 2:len(codes) - 1] if n > 2 else broken[:-1]
        if n in SIZES:
            mixed = h[:count] >> np.uint32(15)
            mixed ^= h[:count]
            mixed *= np.uint32(0x9E3779B1)
            mixed >>= np.uint32(32 - BUCKET_BITS)
            mixed[broken[:count]] = none
            yield mixed


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct words of each text end to end, in slices: ``(codes, weights, rows, starts)``.

    A word that occurs n times weighs 1 + ln n, so that one repeated word is not the whole text. ``weights`` is shorter
    than ``codes``, whose rest is look-ahead; ``rows`` are the texts a slice touches, ``starts`` where each begins in it.
    A text without words has no part in any slice.
    """
    words: list[str] = []
    times: list[int] = []
    rows, ends = [], []
    for i, text in enumerate(texts):
        found = Counter(text.lower().split())
        if found:
            words += found
            times += found.values()
            rows.append(i)
            ends.append(len(words))
    if not words:
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    joined = characters(" " + " ".join(words) + " ")
    weights = np.repeat((1 + np.log(times)).astype(np.float32), lengths)
    begin = np.concatenate([[0], np.cumsum(lengths)[np.array(ends) - 1]])
    for a in range(0, len(weights), SLICE):
        b = min(a + SLICE, len(weights))
        first, last = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b, "left")
        yield joined[a:b + SIZES[-1] - 1], weights[a:b], np.array(rows[first:last]), np.maximum(begin[first:last] - a, 0)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights."""
    found = []
    for codes, w, *_ in pieces([text]):
        for bucket in grams(codes, len(w)):
            whole = np.flatnonzero(bucket < 1 << BUCKET_BITS)
            found.append((bucket[whole], w[whole]))
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.float32)
    ids, row = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return ids, np.bincount(row, np.concatenate([f[1] for f in found]), len(ids)).astype(np.float32)


def pack(found: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag as few bytes: steps between its buckets, then weights as 16-bit numbers."""
    ids, n = found
    return zlib.compress(np.diff(ids, prepend=np.uint32(0)).astype(np.uint32).tobytes() + n.astype(np.float16).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    size = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint32, size), dtype=np.uint32), np.frombuffer(raw, np.float16, size, 4 * size)


class PackedBags:
    """Bags that are unpacked one at a time, whenever they are gone through."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return map(unpack, self.packed)


@dataclass
class Model:
    """``table[bucket]`` is (weight times the bucket's part of the logit, weight); ``bias`` is the logit of an empty text."""

    table: np.ndarray
    bias: float

    @cached_property
    def _pairs(self) -> np.ndarray:
        """Both numbers of a bucket as one, and nothing for the number after the last bucket."""
        return np.append(np.ascontiguousarray(self.table).view(np.complex64).ravel(), np.complex64(0))

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.zeros((len(texts), 2))
        for codes, weights, rows, starts in pieces(texts):
            value = np.zeros(len(weights), np.complex64)
            for bucket in grams(codes, len(weights)):
                value[:len(bucket)] += self._pairs[bucket]
            value *= weights
            total[rows] += np.add.reduceat(value, starts).view(np.float32).reshape(-1, 2)
        mean = total[:, 0] / (total[:, 1] + MASS)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))


def train(bags: list[tuple[np.ndarray, np.ndarray]] | PackedBags, labels: np.ndarray, seed: int = 8) -> Model:
    """Fit vectors and softmax together by gradient steps over shuffled batches. Goes through the bags twice.

    Without rows of both classes there is nothing to tell apart: every score is then the share of toxic rows, smoothed.
    """
    size = 1 << BUCKET_BITS
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros((size, 2), np.float32), float(np.log(share / (1 - share))))
    total, rows = np.zeros(size), np.zeros(size, np.int32)
    for ids, n in bags:
        total[ids] += n
        rows[ids] += 1
    weight = (RARE / (RARE + total / max(total.sum(), 1))).astype(np.float32)
    entries = int(rows[rows >= SEEN].sum())
    rng = np.random.default_rng(seed)
    vectors = np.zeros((DIMENSIONS, size), np.float32)  # an n-gram that was never seen says nothing
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_s, seen_b = np.full_like(softmax, 1e-8), np.full(2, 1e-8, np.float32)
    # what is known of all bags end to end: two large blocks go back to the system whole, many small ones do not
    known_ids, known_share, ends = np.empty(entries, np.uint32), np.empty(entries, np.float32), [0]
    for ids, n in bags:
        w = weight[ids] * n
        known = rows[ids] >= SEEN
        end = ends[-1] + int(known.sum())
        known_ids[ends[-1]:end] = ids[known]
        known_share[ends[-1]:end] = (SCALE * w / (w.sum() + MASS))[known]
        ends.append(end)
    del total, rows
    parts = [(known_ids[a:b], known_share[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    epochs = min(60, max(1, VISITS // len(parts)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(parts))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            lengths = np.array([len(parts[i][0]) for i in chosen])
            ids = np.concatenate([parts[i][0] for i in chosen])
            share = np.concatenate([parts[i][1] for i in chosen])
            filled = np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[filled]
            mean = np.zeros((len(chosen), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS if len(filled) else 0):
                mean[filled, d] = np.add.reduceat(vectors[d][ids] * share, starts)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            back = p @ softmax.T
            for d in range(DIMENSIONS):
                step = np.repeat(back[:, d].astype(np.float32), lengths) * share * np.float32(-VECTOR_RATE * (1 - epoch / epochs))
                np.add.at(vectors[d], ids, step)
            for value, grad, seen in ((softmax, mean.T @ p, seen_s), (bias, p.sum(0), seen_b)):
                seen += np.square(grad)
                value -= rate * grad / np.sqrt(seen)
    part = SCALE * ((softmax[:, 1] - softmax[:, 0]) @ vectors)
    return Model(np.stack([weight * part, weight], 1).astype(np.float32), float(bias[1] - bias[0]))


def held_out() -> Column:
    """Rows that never teach: a third of the ids by checksum. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: dict[int, int] = ROWS_PER_CLASS) -> Model:
    """Train on the labelled rows that are not held out, at most ``rows_per_class`` of each class.

    The sample is chosen before any text is read, by a hash of the id. Bags are made and packed in the tasks from whole
    texts; a bag has at most 2^20 numbers, so what the one training task gets is bounded by the sample. Only text and
    label are used.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = None
    for value, most in rows_per_class.items():
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                packed_bags = pa.array([pack(bag(t or "")) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), packed_bags], names=["doc_id", "toxic", "bag"])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        yield pa.RecordBatch.from_pydict(packed(train(PackedBags([r[2] for r in rows]), np.array([r[1] for r in rows], int))))

    made = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("bigint"), "toxic", "text")
            .mapInArrow(bags, "doc_id bigint, toxic int, bag binary").repartition(1).mapInArrow(teach, "table binary, bias double").collect())
    if not made:  # no rows, no task
        return train([], np.zeros(0, int))
    return Model(np.frombuffer(zlib.decompress(made[0]["table"]), np.float32).reshape(-1, 2), made[0]["bias"])


def packed(model: Model) -> dict[str, pa.Array]:
    """A model as one row. Most of the table is alike, so it is small when compressed."""
    return {"table": pa.array([zlib.compress(model.table.tobytes(), 1)], pa.binary()), "bias": pa.array([model.bias], pa.float64())}


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from its whole text.

    A null text counts as empty; a text without n-grams gets the score of the bias alone. Repeated rows get equal
    scores, no rows give no rows, columns other than doc_id and text are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.scores(texts))],
                                                 names=["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text") \
        .mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with all their columns, in one pass over the texts."""
    schema = docs.schema
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = [t or "" for t in part.column(column).to_pylist()]
                yield part.filter(pa.array(model.scores(texts) < threshold))

    return docs.mapInArrow(run, schema)
