"""Strings of 50 bytes that repeat across documents, by intervals of common prefixes.

Any string of 50 bytes holds the least of its 27 hashed 24-byte strings, so two places that agree over 50 bytes agree in
such an anchor. Anchors that only one document has are dropped first. For the others, the suffix from the anchor on and
the bytes before it are brought together by anchor; suffixes are sorted, a stack scan over the lengths of common prefixes
of neighbours builds the tree of prefix intervals, and in each interval the preceding bytes tell which occurrences extend
to the left in the same way and which differ. An interval and a left extension that together reach 50 bytes are a repeat,
reported with all its occurrences. Exact copies of a text are settled before that, and copies of the same surroundings
inside a task, so that a passage which a third of all documents share reaches the sort once per task.

An anchor that very many documents hold is not gathered: each of its 50-byte strings is settled inside the task where a
smaller document there has it too, and what is left meets by a digest of the string, which spreads it over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.shingles import mix
from cuesheet.operators import skew
from cuesheet.session import materialise

LENGTH = 50
SEED = 24
OFFSETS = LENGTH - SEED  # bytes of a window that may lie before the anchor
WINDOW = OFFSETS + 1
CONTEXT = OFFSETS + LENGTH
SLICE = 1 << 20
TEXT_AT_ONCE = 1 << 22
BYTES_PER_BUCKET = 1 << 25
NO_ID = -(1 << 63)
ANCHOR_ROWS = 1 << 12  # documents from which an anchor's strings are dealt out one by one
BYTES_PER_ANCHOR_ROW = 23  # as a power of two: the bound grows with the corpus, so that at most about 2^20 anchors are over it
WINDOW_BUCKETS = 4  # for each bucket of anchors
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SLICE + 2 * LENGTH, _BASE, np.uint64))])
_DOWN = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SLICE + 2 * LENGTH, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))])
_BYTE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text: the least 24-byte strings of all its 50-byte strings."""
    places, hashes = [], []
    for start in range(0, len(data) - SEED + 1 if len(data) >= LENGTH else 0, SLICE):
        lo = max(0, start - LENGTH)
        part = data[lo:start + SLICE + LENGTH]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * _UP[:len(part)])])
        h = mix((sums[SEED:] - sums[:-SEED]) * _DOWN[:len(part) - SEED + 1])
        least = _sliding(h, WINDOW, np.minimum)
        edge = np.zeros(WINDOW - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == h)
        chosen = chosen[(chosen + lo >= start) & (chosen + lo < start + SLICE)] if len(data) > SLICE else chosen
        places.append(chosen + lo)
        hashes.append(h[chosen])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def contexts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 26 bytes before and the 50 from each place on, a row each; zero beyond the text."""
    padded = np.concatenate([np.zeros(OFFSETS, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    return padded[places[:, None] + np.arange(CONTEXT)[None, :]]


def _ranked(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, :rows.shape[1]] = rows
    return np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def prefix_intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """``(first, last, length, parent's length)`` of all intervals of the sorted suffixes that share ``least`` or more.

    One scan with a stack: a longer common prefix opens an interval, a shorter one closes those above it. The parent's
    length is ``least - 1`` at the roots.
    """
    out = []
    stack: list[tuple[int, int]] = []  # length, first
    values = common.tolist()
    for i in range(1, len(values) + 1):
        now = values[i] if i < len(values) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            parent = max(stack[-1][0] if stack else least - 1, now, least - 1)
            out.append((first, i - 1, length, parent))
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def repeats(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Repeats of 50 bytes around anchors: ``(offset, members, groups)`` for each number of bytes before the anchor.

    ``rows`` are contexts, ``before`` and ``after`` how many of their bytes lie in the text. Members with equal group
    hold the same 50 bytes at the same offset. The interval tree tells which suffixes agree on the right; which agree on
    the left follows from the order of the reversed bytes before the anchor.
    """
    right = _ranked(rows[:, OFFSETS:])
    suffix = rows[right][:, OFFSETS:]
    common = np.minimum(_common(suffix), np.minimum(after[right], np.concatenate([[0], after[right][:-1]])))
    intervals = prefix_intervals(common, SEED)
    reverse = np.ascontiguousarray(rows[:, OFFSETS - 1::-1])
    left = _ranked(reverse)
    same_left = _common(reverse[left])
    if not intervals:
        return
    first, last, length, parent = (np.array(x, np.int64) for x in zip(*intervals, strict=True))
    for offset in range(OFFSETS + 1):
        need = LENGTH - offset
        mine = np.flatnonzero((length >= need) & (parent < need))  # the widest intervals that agree far enough on the right
        if not len(mine):
            continue
        sizes = last[mine] - first[mine] + 1
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        members = right[np.repeat(first[mine], sizes) + within]
        interval = np.repeat(np.arange(len(mine)), sizes)
        left_group = np.empty(len(rows), np.int64)
        left_group[left] = np.cumsum(same_left < offset) if offset else 0
        fits = (before[members] >= offset) & (after[members] >= need)
        members, interval = members[fits], interval[fits]
        yield offset, members, interval * (len(rows) + 1) + left_group[members]


def repeated_offsets(rows: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context and offset, whether the 50 bytes there are also held by a smaller document of the table."""
    found = np.zeros((len(rows), OFFSETS + 1), bool)
    for offset, members, group in repeats(rows, before, after):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(order) else order
        if len(order):
            least = np.minimum.reduceat(docs[members][order], first)
            smallest = np.repeat(least, np.diff(np.append(first, len(order))))
            late = docs[members][order] > smallest
            found[members[order][late], offset] = True
    return found


def spans_of(places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the runs of bytes that the marked offsets of each place cover."""
    edge = np.zeros((len(found), 1), bool)
    change = np.diff(np.concatenate([edge, found, edge], 1).astype(np.int8), axis=1)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    return row, places[row] - (high - 1), places[row] - low + LENGTH


def text_key() -> list[Column]:
    """What identifies a row's text: the id, least where it is null, and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


class _Flush:
    """Texts gathered until they are worth a row per bucket."""

    def __init__(self, size: int):
        self.size, self.held, self.rows = size, 0, []

    def add(self, row: tuple, weight: int) -> bool:
        self.rows.append(row)
        self.held += weight
        return self.held >= self.size


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, int]]:
    for i, (key, th, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True)):
        raw = text.as_buffer()
        yield key, th, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8), i


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    if not len(bucket):
        return
    first = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), slice(a, b)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def shared_anchors(texts: DataFrame, buckets: int, hot_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``(key, th, bucket, low, hot)``: the anchors of each text that another document has too, by 32 bits within a bucket.

    Where documents of one flush share an anchor, they are listed there and then, and only the least and the largest of
    them go to the anchor's bucket, so no anchor sends more than that per flush. Rows with ``hot`` list the anchors that
    ``hot_rows`` texts or more hold. Rarely a hash is shared by chance; that only adds an anchor to look at.
    """
    names = ("low", "owner", "keys", "ths", "at", "many", "n")

    def emit(flush: _Flush) -> pa.RecordBatch:
        keys = np.array([r[0] for r in flush.rows], np.int64)
        ths = np.array([r[1] for r in flush.rows], np.int64)
        h = np.concatenate([r[2] for r in flush.rows])
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(r[2]) for r in flush.rows])
        order = np.lexsort((keys[owner], h))
        h, owner = h[order], owner[order]
        first = _heads(h)
        last = np.append(first[1:], len(h)) - 1
        several = keys[owner[first]] < keys[owner[last]]
        listed = np.repeat(several, last - first + 1)
        listed[first], listed[last] = False, False
        size = np.zeros(len(h), np.uint32)
        size[first] = np.where(several, np.maximum(last - first - 1, 0), 0)  # texts of the anchor that are listed here
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        low = (h >> np.uint64(32)).astype(np.uint32)
        out = {name: [] for name in ("bucket", *names)}

        def put(**values) -> None:
            for name, column in out.items():
                column.append(values.get(name, b""))

        gone = np.flatnonzero(listed)
        gone = gone[np.lexsort((bucket[gone], owner[gone]))]
        if len(gone):
            used, local = np.unique(owner[gone], return_inverse=True)
            put(bucket=-1 - int(ths[used[0]] % buckets), low=low[gone].tobytes(), owner=local.astype(np.uint32).tobytes(), keys=keys[used].tobytes(),
                ths=ths[used].tobytes(), at=bucket[gone].astype(np.uint32).tobytes())
        rest = np.flatnonzero(~listed)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        for b, part in _cut(bucket[rest]):
            i = rest[part]
            used, local = np.unique(owner[i], return_inverse=True)
            many = i[size[i] > 0]
            put(bucket=b, low=low[i].tobytes(), owner=local.astype(np.uint32).tobytes(), keys=keys[used].tobytes(), ths=ths[used].tobytes(),
                many=low[many].tobytes(), n=size[many].tobytes())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in names)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = _Flush(TEXT_AT_ONCE)
        for batch in batches:
            for key, th, data, _ in _texts(batch):
                h = np.unique(anchors(data)[1])
                if len(h) and flush.add((key, th, h), len(data)):
                    yield emit(flush)
                    flush = _Flush(TEXT_AT_ONCE)
        if flush.rows:
            yield emit(flush)

    def common(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        low, keys, ths = _joined(table, "low", np.uint32), _joined(table, "keys", np.int64), _joined(table, "ths", np.int64)
        sizes = [v.as_buffer().size // 8 for v in table.column("keys")]
        starts = np.repeat(np.cumsum([0, *sizes[:-1]]), [v.as_buffer().size // 4 for v in table.column("owner")])
        owner = _joined(table, "owner", np.uint32).astype(np.int64) + starts
        if bucket < 0:
            at, hot = _joined(table, "at", np.uint32).astype(np.int64), np.empty(0, np.uint32)
        else:
            order = np.lexsort((keys[owner], low))
            low, owner = low[order], owner[order]
            first = _heads(low)
            last = np.append(first[1:], len(low)) - 1
            count = last - first + 1
            np.add.at(count, np.searchsorted(low[first], _joined(table, "many", np.uint32)), _joined(table, "n", np.uint32).astype(np.int64))
            several = keys[owner[first]] < keys[owner[last]]
            hot = low[first][several & (count >= hot_rows)]
            keep = np.repeat(several, last - first + 1)
            low, owner = low[keep], owner[keep]
            at = np.full(len(low), bucket, np.int64)
        order = np.lexsort((at, owner))
        low, owner, at = low[order], owner[order], at[order]
        parts = [part for _, part in _cut(owner * buckets + at)]
        who, where = [int(owner[p.start]) for p in parts], [int(at[p.start]) for p in parts]
        more = [hot.tobytes()] if len(hot) else []
        return pa.table({
            "key": pa.array([*(int(keys[o]) for o in who), *(NO_ID for _ in more)], pa.int64()), "th": pa.array([*(int(ths[o]) for o in who), *(0 for _ in more)], pa.int64()),
            "bucket": pa.array([*where, *(bucket for _ in more)], pa.int64()), "low": pa.array([*(low[p].tobytes() for p in parts), *more], pa.binary()),
            "hot": pa.array([False] * len(parts) + [True] * len(more), pa.bool_())})

    found = texts.select("key", "th", "text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} binary" for n in names))
    return found.groupBy("bucket").applyInArrow(common, "key bigint, th bigint, bucket bigint, low binary, hot boolean")


def anchor_codes(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    return (low.astype(np.uint64) << np.uint64(20)) | np.asarray(bucket, np.uint64)


def hot_anchors(shared: DataFrame) -> np.ndarray:
    """Codes of the anchors over the bound, in order; their number is bounded by the size of the corpus over the bound."""
    rows = shared.where("hot").select("bucket", "low").collect()
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(anchor_codes(np.frombuffer(r["low"], np.uint32), r["bucket"]) for r in rows)]))


def unsettled_windows(rows: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, bytes]]]:
    """Which offsets of each context hold a string that a smaller document of the table has, and the strings left over.

    Those come as ``(members, offset of each, digests)``, one entry per offset.
    """
    found, left = np.zeros((len(rows), OFFSETS + 1), bool), []
    for offset in range(OFFSETS + 1):
        fits = np.flatnonzero((before >= offset) & (after >= LENGTH - offset))
        window = np.ascontiguousarray(rows[fits, OFFSETS - offset:OFFSETS - offset + LENGTH])
        wide = np.zeros((len(fits), -(-LENGTH // 8) * 8), np.uint8)
        wide[:, :LENGTH] = window
        order = np.lexsort([docs[fits], *wide.view(np.uint64).T])
        first = np.concatenate([[True], (wide[order][1:] != wide[order][:-1]).any(1)])[:len(order)]
        group = np.cumsum(first) - 1
        late = docs[fits][order] > docs[fits][order][first][group] if len(order) else np.empty(0, bool)
        found[fits[order][late], offset] = True
        code = np.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in window[order][first]], "S16") if len(order) else np.empty(0, "S16")
        digests = np.frombuffer(code.tobytes(), np.uint64).reshape(-1, 2)[group[~late]]
        left.append((fits[order][~late], np.full(int((~late).sum()), offset), digests))
    return found, left


_OCCURRENCES = "bucket bigint, n bigint, rows binary, docs binary, ths binary, places binary, before binary, after binary, starts binary, ends binary, digests binary"


def occurrences(texts: DataFrame, shared: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Contexts of the shared anchors by bucket, and spans that are settled already.

    Of equal contexts in one task only that of the smallest document goes on. The others hold nothing that it does not
    hold, so all they cover is repeated: rows of a negative bucket have their spans. Contexts travel compressed. Those of
    ``hot`` anchors do not travel: their strings go on by digest, in buckets beyond ``buckets``.
    """
    codes = texts.sparkSession.sparkContext.broadcast(hot)

    def emit(flush: _Flush) -> pa.RecordBatch:
        keys = np.concatenate([np.full(len(r[2]), r[0], np.int64) for r in flush.rows])
        ths = np.concatenate([np.full(len(r[2]), r[1], np.int64) for r in flush.rows])
        places, h = np.concatenate([r[2] for r in flush.rows]), np.concatenate([r[3] for r in flush.rows])
        rows = np.concatenate([r[4] for r in flush.rows])
        size = np.concatenate([np.full(len(r[2]), r[5], np.int64) for r in flush.rows])
        before, after = np.minimum(places, OFFSETS), np.minimum(size - places, LENGTH)
        order = np.lexsort((keys, rows[:, :8].copy().view(">u8").ravel(), before, after, h))
        equal = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        equal[1:] = (h[a] == h[b]) & (before[a] == before[b]) & (after[a] == after[b]) & (rows[a] == rows[b]).all(1)
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
        smallest = keys[order][head]
        settled = order[equal & (keys[order] > smallest)]
        rest = order[~equal | (keys[order] == smallest)]
        windows = (np.arange(OFFSETS + 1)[None, :] <= before[settled][:, None]) & (LENGTH - np.arange(OFFSETS + 1)[None, :] <= after[settled][:, None])
        row, start, end = spans_of(places[settled], windows)
        at = settled[row]
        is_hot = np.isin(anchor_codes(h[rest] >> np.uint64(32), h[rest] % np.uint64(buckets)), codes.value)
        dealt, rest = rest[is_hot], rest[~is_hot]
        marked, left = unsettled_windows(rows[dealt], before[dealt], after[dealt], keys[dealt]) if len(dealt) else (np.zeros((0, OFFSETS + 1), bool), [])
        row, hot_start, hot_end = spans_of(places[dealt], marked)
        at, start, end = np.concatenate([at, dealt[row]]), np.concatenate([start, hot_start]), np.concatenate([end, hot_end])
        out = {name: [] for name in ("bucket", "n", "rows", "docs", "ths", "places", "before", "after", "starts", "ends", "digests")}

        def put(**values) -> None:
            for name, column in out.items():
                column.append(values.get(name, b""))

        if len(at):
            put(bucket=-1 - int(ths[at[0]] % buckets), n=len(at), docs=keys[at].tobytes(), ths=ths[at].tobytes(), starts=start.astype(np.int32).tobytes(), ends=end.astype(np.int32).tobytes())
        bucket = (h[rest] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rest, bucket = rest[by], bucket[by]
        for b, at in _cut(bucket):
            i = rest[at]
            put(bucket=b, n=len(i), rows=zstandard.compress(rows[i].tobytes()), docs=keys[i].tobytes(), ths=ths[i].tobytes(), places=places[i].astype(np.int32).tobytes(),
                before=before[i].astype(np.uint8).tobytes(), after=after[i].astype(np.uint8).tobytes())
        if left:
            member = dealt[np.concatenate([m for m, *_ in left])]
            start = places[member] - np.concatenate([o for _, o, _ in left])
            digests = np.concatenate([d for *_, d in left])
            bucket = buckets + (digests[:, 0] % np.uint64(buckets * WINDOW_BUCKETS)).astype(np.int64)
            by = np.lexsort((start, ths[member], bucket))
            for b, part in _cut(bucket[by]):
                i = by[part]
                put(bucket=b, n=len(i), docs=zstandard.compress(keys[member[i]].tobytes()), ths=zstandard.compress(ths[member[i]].tobytes()),
                    starts=start[i].astype(np.int32).tobytes(), digests=digests[i].tobytes())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((n, pa.binary()) for n in list(out)[2:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = _Flush(TEXT_AT_ONCE)
        for batch in batches:
            for key, th, data, i in _texts(batch):
                wanted = np.concatenate([anchor_codes(np.frombuffer(s["low"], np.uint32), s["bucket"]) for s in batch.column("shared")[i].as_py()])
                places, h = anchors(data)
                keep = np.isin(anchor_codes(h >> np.uint64(32), h % np.uint64(buckets)), wanted)
                places, h = places[keep], h[keep]
                for a in range(0, len(places), TEXT_AT_ONCE // CONTEXT):
                    part = slice(a, a + TEXT_AT_ONCE // CONTEXT)
                    if flush.add((key, th, places[part], h[part], contexts(data, places[part]), len(data)), CONTEXT * len(places[part])):
                        yield emit(flush)
                        flush = _Flush(TEXT_AT_ONCE)
        if flush.rows:
            yield emit(flush)

    gathered = shared.where("not hot").groupBy("key", "th").agg(F.collect_list(F.struct("bucket", "low")).alias("shared"))
    return texts.join(gathered.hint("merge"), ["key", "th"]).select("key", "th", "text", "shared").mapInArrow(run, _OCCURRENCES)


def _span_rows(docs: np.ndarray, ths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """A row per text: its spans, those that touch merged."""
    order = np.lexsort((starts, ths, docs))
    docs, ths, starts, ends = docs[order], ths[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    new = np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(ths) != 0)]) if len(docs) else np.empty(0, bool)
    text = np.cumsum(new) - 1
    wide = np.int64(1) << 33  # a text's spans end before the next text's begin
    reach = np.maximum.accumulate(text * wide + ends) if len(docs) else ends
    gap = new.copy()
    gap[1:] |= text[1:] * wide + starts[1:] > reach[:-1]
    head = np.flatnonzero(gap)
    first, merged_end = starts[head], (reach[np.append(head[1:], len(docs)) - 1] - text[head] * wide) if len(head) else ends
    parts = list(_cut(text[head])) if len(head) else []
    return pa.table({
        "key": pa.array([int(docs[head[at.start]]) for _, at in parts], pa.int64()), "th": pa.array([int(ths[head[at.start]]) for _, at in parts], pa.int64()),
        "starts": pa.array([first[at].astype(np.int32).tobytes() for _, at in parts], pa.binary()),
        "ends": pa.array([merged_end[at].astype(np.int32).tobytes() for _, at in parts], pa.binary())})


_SPANS = "key bigint, th bigint, starts binary, ends binary"


def repeated_spans(found: DataFrame) -> DataFrame:
    """``(key, th, starts, ends)`` of what a smaller document holds too; a text may have several rows."""
    def resolve(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return _span_rows(_joined(table, "docs", np.int64), _joined(table, "ths", np.int64), _joined(table, "starts", np.int32), _joined(table, "ends", np.int32))
        if table.column("digests")[0].as_buffer().size:
            docs, ths = (np.concatenate([np.frombuffer(zstandard.decompress(v.as_py()), np.int64) for v in table.column(n)]) for n in ("docs", "ths"))
            digests, starts = _joined(table, "digests", np.uint64).reshape(-1, 2), _joined(table, "starts", np.int32)
            order = np.lexsort((docs, digests[:, 1], digests[:, 0]))
            first = np.concatenate([[True], (digests[order][1:] != digests[order][:-1]).any(1)])
            late = order[docs[order] > docs[order][first][np.cumsum(first) - 1]]
            return _span_rows(docs[late], ths[late], starts[late], starts[late] + LENGTH)
        rows = np.concatenate([np.frombuffer(zstandard.decompress(v.as_py()), np.uint8) for v in table.column("rows")]).reshape(-1, CONTEXT)
        docs, places = _joined(table, "docs", np.int64), _joined(table, "places", np.int32).astype(np.int64)
        marked = repeated_offsets(rows, _joined(table, "before", np.uint8).astype(np.int64), _joined(table, "after", np.uint8).astype(np.int64), docs)
        row, start, end = spans_of(places, marked)
        return _span_rows(docs[row], _joined(table, "ths", np.int64)[row], start, end)

    return found.groupBy("bucket").applyInArrow(resolve, _SPANS)


def _without(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``(key, th, n_removed, n_spans, kept_sha256)`` of the texts that have spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "th": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for key, th, data, i in _texts(batch):
                mark = np.zeros(len(data) + 1, np.int32)
                for s in batch.column("spans")[i].as_py():
                    np.add.at(mark, np.frombuffer(s["starts"], np.int32), 1)
                    np.add.at(mark, np.frombuffer(s["ends"], np.int32), -1)
                gone = np.cumsum(mark)[:-1] > 0
                runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                for name, value in zip(out, (key, th, int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    gathered = spans.groupBy("key", "th").agg(F.collect_list(F.struct("starts", "ends")).alias("spans"))
    return texts.join(gathered.hint("merge"), ["key", "th"]).select("key", "th", "text", "spans").mapInArrow(
        run, "key bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``documents``, on its UTF-8 bytes.

    Removed is every byte of a 50-byte string that also occurs in a document with a smaller doc_id. A null text is empty.
    Rows of one doc_id are not smaller than each other; a null doc_id is smaller than all others. No rows give no rows,
    other columns are ignored. Of equal texts only the first is searched: the others are repeated from end to end.
    """
    slim = materialise(docs.select("doc_id", *text_key(), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
                                   F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")))
    groups = materialise(slim.groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    rows = materialise(skew.salted_lookup(slim, groups.drop("n"), ["sha"], groups, "n", ["key"]))
    copies, originals = rows.where(F.col("key") > F.col("first")), rows.where(F.col("key") == F.col("first"))
    gone = copies.select("key", "th").distinct()
    texts = docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text"))
    searched = texts.join(F.broadcast(gone) if skew.is_small(gone) else gone.hint("merge"), ["key", "th"], "left_anti")
    total = originals.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = min(max(16, -(-total // BYTES_PER_BUCKET)), 1 << 20)
    shared = materialise(shared_anchors(searched, buckets, max(anchor_rows, total >> BYTES_PER_ANCHOR_ROW)))
    spans = materialise(repeated_spans(occurrences(searched, shared, buckets, hot_anchors(shared))))
    changed = materialise(_without(searched, spans).dropDuplicates(["key", "th"]))
    long = F.col("n_bytes") >= LENGTH
    whole = copies.select("doc_id", "n_bytes", F.when(long, F.col("n_bytes")).otherwise(0).alias("n_removed"), long.cast("bigint").alias("n_spans"),
                          F.when(long, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"))
    kept = originals.join(changed.hint("merge"), ["key", "th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return kept.union(whole)
