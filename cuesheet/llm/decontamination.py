"""Benchmark passages in documents, by latent semantic retrieval.

Passages are runs of 32 words that start at every 16th. A randomised singular value decomposition of their TF-IDF matrix
gives a space of few dimensions in which passages and benchmark items are compared by cosine; the document frequencies
behind it cover all documents, the decomposition is fitted on all passages of all documents and all items. A passage near
an item is then read word by word: the longest common subsequence must hold most of the item, and its answer, the last
words of the item, must be there too. So a paraphrase is found, and a text on the same subject is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.shingles import text_bytes, word_hashes
from cuesheet.session import materialise, shuffles_dropped, written

BLOCK, BLOCKS = 16, 2
TERM_BITS = 14
DIMENSIONS, OVERSAMPLING = 64, 8
ITEM_WORDS = 48  # an item is sought in pieces of so many words, the last one up to half as long again
ITEMS_WEIGH = 4  # times as much as all passages together, so that they are not lost among them
LEAST_COSINE = 0.35
LEAST_SHARE, LEAST_ANSWER = 0.6, 0.6
WORDS_AT_ONCE = 1 << 15
BLOCKS_AT_ONCE, BLOCKS_IN_CACHE = 1 << 14, 1 << 9
FIXED = 1 << 24  # products of passages are summed as whole numbers of this part, so their order plays no part
_WORD_BYTE = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _WORD_BYTE[_a:_b] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, A to Z in lower case) and the n + 1 borders of the texts."""
    data, borders = text_bytes(texts)
    solid = _WORD_BYTE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(first)
    return word_hashes(data, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, borders)


def terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def term_table(docs: DataFrame) -> DataFrame:
    """``(terms)``: two bytes for each word of a document, written once for all passes over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                words, cuts = words_of(batch.column("text").slice(start, 256))
                data = [pa.py_buffer(x) for x in ((2 * cuts).astype(np.int32), terms(words).astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, *data])], ["terms"])

    return written(docs.select("text").mapInArrow(run, "terms binary"), "terms")


def _terms_at_once(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms of up to ``n`` texts and the borders of the texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            part = batch.column("terms").slice(start, n).cast(pa.large_binary())
            _, offsets, data = part.buffers()
            cuts = np.frombuffer(offsets, np.int64)[part.offset:part.offset + len(part) + 1]
            held = np.frombuffer(data, np.uint8)[cuts[0]:cuts[-1]] if data else np.zeros(0, np.uint8)
            yield held.view(np.uint16), (cuts - cuts[0]) // 2


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many documents each term bucket occurs, the number of documents and of passages; counted over all of them.

    A task sends one count per bucket, so what is shuffled and collected does not grow with the texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, held = np.zeros(1 << TERM_BITS, np.int64), 0, 0
        for term, cuts in _terms_at_once(batches, 256):
            owner = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64), np.diff(cuts))
            distinct = np.unique(owner << np.int64(TERM_BITS) | term)
            found += np.bincount(distinct & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
            n += len(cuts) - 1
            held += int((-(-np.diff(cuts) // BLOCK)).sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, [-1, -2]), "n": np.append(found[at], [n, held])})

    rows = texts.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, total, n_passages = np.zeros(1 << TERM_BITS, np.int64), 0, 0
    for r in rows:
        if r["term"] == -1:
            total = r["n"]
        elif r["term"] == -2:
            n_passages = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return counts, total, n_passages


def inverse_frequencies(counts: np.ndarray, total: int) -> np.ndarray:
    """Squared, so that a few telling words outweigh the frequent ones that any two passages share."""
    return np.square(np.log((1 + total) / (1 + counts)) + 1).astype(np.float32)


def item_pieces(cuts: np.ndarray) -> list[tuple[int, int]]:
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        while b - a > ITEM_WORDS * 3 // 2:
            out.append((a, a + ITEM_WORDS))
            a += ITEM_WORDS
        if b > a:
            out.append((a, b))
    return out


def sparse_rows(words: np.ndarray, spans: list[tuple[int, int]], idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """TF-IDF rows of length one: term numbers and weights."""
    out = []
    for a, b in spans:
        term, n = np.unique(terms(words[a:b]), return_counts=True)
        w = n * idf[term]
        out.append((term.astype(np.int32).tobytes(), (w / np.linalg.norm(w)).astype(np.float32).tobytes()))
    return out


PARTS = 64  # row blocks in which partial products are summed
TASKS = 2  # the items are bounded, and each task sends a whole partial product


def _summed(rows: DataFrame, product: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of what ``product`` adds for a batch of them: partial sums per task, then per block of rows.

    ``product`` gets (row starts, terms, weights) and returns (target rows, values).
    """
    height = -(-shape[0] // PARTS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height * PARTS, shape[1]), np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                term = [np.frombuffer(x, np.int32) for x in part.column("term").to_pylist()]
                weight = np.concatenate([np.frombuffer(x, np.float32) for x in part.column("weight").to_pylist()])
                starts = np.cumsum([0, *(len(t) for t in term[:-1])])
                at, value = product(starts, np.concatenate(term), weight)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                total[at[order][first]] += np.add.reduceat(value[order], first, axis=0)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(PARTS), pa.int32()),
            "value": pa.array([total[i * height:(i + 1) * height].tobytes() for i in range(PARTS)], pa.binary())})

    return _added(rows.coalesce(TASKS).mapInArrow(partial, "part int, value binary"), (height * PARTS, shape[1]), np.float32)[:shape[0]]


def _added(partials: DataFrame, shape: tuple[int, int], kind: type) -> np.ndarray:
    """Sum of the matrices that come in ``PARTS`` blocks of rows; float32 ones are added in float64."""
    def add(table: pa.Table) -> pa.Table:
        value = sum(np.frombuffer(v.as_buffer(), kind).astype(np.float64 if kind is np.float32 else kind) for v in table.column("value"))
        return pa.table({"part": table.column("part").slice(0, 1), "value": pa.array([value.astype(kind).tobytes()], pa.binary())})

    height = shape[0] // PARTS
    out = np.zeros(shape, kind)
    with shuffles_dropped(partials.sparkSession):
        for r in partials.groupBy("part").applyInArrow(add, "part int, value binary").collect():
            out[r["part"] * height:(r["part"] + 1) * height] = np.frombuffer(r["value"], kind).reshape(height, shape[1])
    return out


def squared_lengths(term: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of the TF-IDF vectors of rows of terms: a term that comes n times counts n times n."""
    term = np.sort(term, axis=1)
    at = np.arange(term.shape[1], dtype=np.int16)
    begins = np.zeros(term.shape, np.int16)
    begins[:, 1:] = np.where(term[:, 1:] != term[:, :-1], at[1:], 0)
    return ((2 * (at - np.maximum.accumulate(begins, axis=1)) + 1) * np.square(idf)[term]).sum(1)  # 1 + 3 + 5 + ... = n * n


def passage_products(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the TF-IDF rows of all passages of all documents, each of length one, times ``basis``.

    A passage is the sum of its blocks, so every word is projected once and gets its product back once.
    """
    width, size = basis.shape[1], 1 << TERM_BITS
    weighted = np.concatenate([basis * idf[:, None], np.zeros((1, width), np.float32)])
    weights = np.append(idf, np.float32(0))

    def products(blocks: np.ndarray, goes_on: np.ndarray, begin: int, end: int) -> np.ndarray:
        """What the words of the blocks from ``begin`` to ``end`` get, from all passages that they are in."""
        low, high = max(begin - 1, 0), min(end + 1, len(blocks))
        vector = np.concatenate([weighted[blocks[i:min(i + BLOCKS_IN_CACHE, high)]].sum(1) for i in range(low, high, BLOCKS_IN_CACHE)])
        near, two = blocks[low:end], goes_on[low:end]
        pairs = np.full((len(near), BLOCK * BLOCKS), size, np.uint16)
        pairs[:, :BLOCK] = near
        pairs[two, BLOCK:] = blocks[low + 1 + np.flatnonzero(two)]
        passage = vector[:len(near)].copy()
        passage[two] += vector[1 + np.flatnonzero(two)]
        passage /= squared_lengths(pairs, weights)[:, None]
        got = passage[begin - low:].copy()
        behind = np.flatnonzero(goes_on[max(begin - 1, 0):end - 1]) + (begin == 0)  # blocks that end a passage
        got[behind] += passage[behind - 1 + begin - low]
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for term, cuts in _terms_at_once(batches, 1024):
            lengths = np.diff(cuts)
            n = -(-lengths // BLOCK)
            if not n.sum():
                continue
            total = np.zeros((width, size + 1), np.int64) if total is None else total
            blocks = np.full(BLOCK * n.sum(), size, np.uint16)
            blocks[np.arange(len(term)) + np.repeat(BLOCK * (np.cumsum(n) - n) - cuts[:-1], lengths)] = term
            owner = np.repeat(np.arange(len(n)), n)
            goes_on = np.append(owner[1:] == owner[:-1], False)
            blocks = blocks.reshape(-1, BLOCK)
            for begin in range(0, len(blocks), BLOCKS_AT_ONCE):
                end = min(begin + BLOCKS_AT_ONCE, len(blocks))
                got = np.rint(products(blocks, goes_on, begin, end).T.astype(np.float64) * FIXED)
                at = blocks[begin:end].reshape(-1).astype(np.intp)
                for k in range(width):
                    total[k] += np.bincount(at, np.repeat(got[k], BLOCK), size + 1).astype(np.int64)
        if total is not None:
            height = size // PARTS
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(PARTS), pa.int32()),
                "value": pa.array([np.ascontiguousarray(total[:, i * height:(i + 1) * height].T).tobytes() for i in range(PARTS)], pa.binary())})

    return _added(texts.mapInArrow(run, "part int, value binary"), (size, width), np.int64) * (idf[:, None].astype(np.float64) / FIXED)


def latent_axes(rows: DataFrame, extra: list[tuple[bytes, bytes]], extra_weight: float, k: int = DIMENSIONS, seed: int = 9,
                more: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Leading right singular vectors of the sparse rows, by random projection with one power step.

    ``extra`` rows, few and weighted by ``extra_weight``, are added to the matrix, and so are the rows whose Gram matrix
    ``more`` multiplies with a basis. The rows stay distributed; only matrices of as many columns as dimensions come together.
    """
    width, size = k + OVERSAMPLING, 1 << TERM_BITS
    spark = rows.sparkSession
    if extra:
        scaled = [(t, (np.frombuffer(w, np.float32) * np.float32(extra_weight)).tobytes()) for t, w in extra]
        rows = materialise(rows.union(spark.createDataFrame([(bytearray(t), bytearray(w)) for t, w in scaled], "term binary, weight binary")))

    def image(b: np.ndarray) -> np.ndarray:
        def product(starts, term, weight):
            projected = np.add.reduceat(b[term] * weight[:, None], starts, axis=0)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
            return term, projected[owner] * weight[:, None]

        found = _summed(rows, product, (size, width)).astype(np.float64)
        return found if more is None else found + more(b)

    basis = np.linalg.qr(image(np.random.default_rng(seed).normal(size=(size, width)).astype(np.float32)))[0].astype(np.float32)
    found = image(basis)
    # the second image tells what the matrix does within its own span, so that needs no pass of its own (Nystroem)
    core = basis.T.astype(np.float64) @ found
    values, turn = np.linalg.eigh((core + core.T) / 2)
    held = values > 1e-6 * values[-1]
    root = found @ (turn[:, held] / np.sqrt(values[held]))
    values, turn = np.linalg.eigh(root.T @ root)
    axes = np.zeros((size, k), np.float32)
    axes[:, :len(values)] = (root @ (turn / np.sqrt(values)))[:, ::-1][:, :k]
    return axes


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; ``a`` lies in the bits of one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & places.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Index:
    """What a task needs to search its texts: the axes times the term weights, and the items."""

    axes: np.ndarray
    idf: np.ndarray
    pieces: np.ndarray  # latent vectors, scaled to score 1 with their own text
    piece_item: list[int]
    piece_at: list[int]
    items: list[np.ndarray]
    ids: list[int]

    def __post_init__(self):
        self.item_words = [item.tolist() for item in self.items]

    def candidates(self, words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``(text, word, piece, cosine)`` of the passages near an item, some words at a time."""
        step = BLOCK * (WORDS_AT_ONCE // BLOCK)
        for text, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b - a > step:
                for s in range(a, b, step):
                    yield from self._near(words, [text], [(s, min(s + step + BLOCK * (BLOCKS - 1), b))])
        short = [(t, (a, b)) for t, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if 0 < b - a <= step]
        group: list[tuple[int, tuple[int, int]]] = []
        held = 0
        for entry in [*short, None]:
            if entry is None or held + entry[1][1] - entry[1][0] > step:
                if group:
                    yield from self._near(words, [t for t, _ in group], [s for _, s in group])
                group, held = [], 0
            if entry is not None:
                group.append(entry)
                held += entry[1][1] - entry[1][0]

    def _near(self, words: np.ndarray, texts: list[int], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, float]]:
        used = np.concatenate([words[a:b] for a, b in spans])
        lengths = np.array([b - a for a, b in spans])
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(spans)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        # every text starts a block; what is missing in its last one is a term that weighs nothing
        shift = np.repeat(BLOCK * (np.cumsum(blocks) - blocks) - (np.cumsum(lengths) - lengths), lengths)
        term = np.full(BLOCK * len(owner), 1 << TERM_BITS)
        term[np.arange(len(used)) + shift] = terms(used)
        vector = self.axes[term].reshape(-1, BLOCK, self.axes.shape[1]).sum(1)
        mass = (self.idf[term] ** 2).reshape(-1, BLOCK).sum(1)
        for shift in range(1, BLOCKS):
            same = np.concatenate([owner[shift:] == owner[:-shift], np.zeros(min(shift, len(owner)), bool)])
            if shift == 1:
                total, weight = vector.copy(), mass.copy()
            at = np.flatnonzero(same)
            total[at] += vector[at + shift]
            weight[at] += mass[at + shift]
        cosine = (total @ self.pieces.T) / np.sqrt(weight)[:, None]
        for i, piece in zip(*(x.tolist() for x in np.nonzero(cosine >= LEAST_COSINE)), strict=True):
            yield texts[owner[i]], spans[owner[i]][0] + int(within[i]) * BLOCK, piece, float(cosine[i, piece])

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, int]]:
        """``(text, item number, share, cosine, word)``: the best passage of each item that is confirmed in a text."""
        words, cuts = words_of(texts)
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        seen = set()
        for text, at, piece, cosine in self.candidates(words, cuts):
            number = self.piece_item[piece]
            item = self.items[number]
            begin = at - self.piece_at[piece]
            key = (text, number, begin // BLOCK)
            if key in seen:
                continue
            seen.add(key)
            lo = max(int(cuts[text]), begin - BLOCK * BLOCKS)
            hi = min(int(cuts[text + 1]), begin + len(item) + BLOCK * BLOCKS)
            around = set(words[lo:hi].tolist())
            if sum(w in around for w in self.item_words[number]) < LEAST_SHARE * len(item):
                continue  # no subsequence can be longer than the words that are there
            width, step = len(item) + len(item) // 4 + 2, max(1, len(item) // 8)
            share, region = max(((common_subsequence(item, words[s:min(s + width, hi)]) / len(item), s) for s in range(lo, max(hi - width, lo) + step, step)))
            region = words[region:min(region + width, hi)]
            answer = item[-max(3, len(item) // 5):]
            confirmed = share >= (LEAST_SHARE if len(item) >= 8 else 1.0) and \
                common_subsequence(answer, region) >= LEAST_ANSWER * len(answer)
            if confirmed and share > best.get((text, number), (0.0,))[0]:
                best[text, number] = (share, cosine, at - int(cuts[text]))
        return [(text, number, *found) for (text, number), found in sorted(best.items())]


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index | None:
    """Frequencies over all documents, axes from all their passages and all items. None where no item has a word.

    The items are gathered here and sent to every task: the benchmark must be of bounded size.
    """
    rows = sorted({(r["item_id"], r["text"]) for r in benchmark.select(F.col("item_id").cast("bigint"), "text").collect() if r["text"] and r["item_id"] is not None})
    words, cuts = words_of(pa.array([t for _, t in rows], pa.string()))
    spans = item_pieces(cuts)
    if not spans:
        return None
    texts = term_table(docs)
    counts, total, n_passages = document_frequencies(texts)
    idf = inverse_frequencies(counts, total)
    heavy = np.float32(max(1.0, ITEMS_WEIGH * n_passages / len(spans)) ** 0.5)
    item_rows = [(bytearray(t), bytearray((np.frombuffer(w, np.float32) * heavy).tobytes())) for t, w in sparse_rows(words, spans, idf)]
    rows_of_items = docs.sparkSession.createDataFrame(item_rows, "term binary, weight binary")
    axes = latent_axes(rows_of_items, [], 1.0, more=lambda b: passage_products(texts, idf, b)) * idf[:, None]
    vectors = np.stack([axes[terms(words[a:b])].sum(0) for a, b in spans])
    # scaled so that a piece scores 1 with itself, however much of it the axes hold
    length = np.sqrt([(idf[terms(words[a:b])] ** 2).sum() for a, b in spans])
    vectors *= (length / np.maximum((vectors ** 2).sum(1), 1e-9))[:, None]
    number = np.searchsorted(cuts, [a for a, _ in spans], "right") - 1
    nothing = np.zeros((1, axes.shape[1]), np.float32)
    return Index(np.concatenate([axes, nothing]), np.append(idf, np.float32(0)), vectors, number.tolist(), [a - int(cuts[n]) for (a, _), n in zip(spans, number, strict=True)],
                 [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [i for i, _ in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, share, cosine, at_word)`` for each benchmark item that a document holds.

    Every document is searched whole for every item. ``share`` is the part of the item in the common subsequence,
    ``at_word`` the first word of the passage. A null or empty text holds nothing, an item without words or id is no
    item, repeated rows and items are reported each, other columns are ignored, and no rows or no items give no rows.
    """
    schema = "doc_id bigint, item_id bigint, share double, cosine double, at_word bigint"
    index = build_index(docs, benchmark)
    if index is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = index.search(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                    pa.array([round(f[3], 4) for f in found], pa.float64()), pa.array([f[4] for f in found], pa.int64()),
                ], names=["doc_id", "item_id", "share", "cosine", "at_word"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no item, with all their columns."""
    index = build_index(docs, benchmark)
    if index is None:
        return docs
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in index.search(part.column(column))]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
