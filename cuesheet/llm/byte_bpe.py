"""Byte-level BPE: encode by folding ranked merges over the bytes of distinct words, decode by joining pieces.

A text is cut into words by the pattern of the vocabulary. Each distinct word of a stretch of documents becomes a row with
its bytes and the ranks of all pieces that occur in it, and a higher-order function folds these merges, least rank first,
over the bytes: a literal map from rank to pair tells which two neighbours become one piece. Then every document takes the
ids of its words.

Taking each rank once, in order, is what merging the least pair again and again comes to, if every piece is merged from
pieces of lower ranks. A pair that a merge creates then has a higher rank than the merge: had it a lower one, its own
bytes would have been one piece before. Loading a vocabulary checks this.

Words, merges and documents stay in one task: it writes a word's row before the first document that needs it, and reads
the ids back in that order. So no text and no dictionary is shuffled, whatever words are frequent.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A longer word is encoded in overlapping windows, half a window apart, that are joined where they agree.
WINDOW = 256
#: Distinct words and their characters that a task remembers before it starts anew: bounds memory, not results.
REMEMBERED_WORDS, REMEMBERED_CHARACTERS = 1 << 19, 1 << 23
DOCUMENTS_AT_ONCE = 256


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts a text into words."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a base64 string and its rank per line."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)

    @cached_property
    def splitters(self) -> tuple[str, str]:
        """The pattern for Python's ``re``, with the character classes of the library, whatever Unicode version it has.

        The first is for texts without characters beyond the 16-bit range, in which a class is a table; the second for any.
        """
        single = {bytes([i]): i for i in range(256)}

        def members(name: str, upto: int) -> str:
            every = "".join(chr(i) for i in range(upto) if not 0xD800 <= i < 0xE000)
            library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            return spans(library.decode_bytes(library.encode_ordinary(every)).decode())

        def pattern(upto: int) -> str:
            letters, numbers, spaces = members(r"\p{L}", upto), members(r"\p{N}", upto), members(r"\s", upto)
            cut = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
            return cut.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")

        return pattern(0x10000), pattern(0x110000)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """The ids of the two pieces that a rank merges. A piece that merges never yield has no pair."""
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has every byte; missing: {missing[:10]}")
        found = {}
        for piece, rank in self.ranks.items():
            if len(piece) > 1:
                parts = merge(piece, self.ranks, rank)
                if len(parts) == 2:
                    found[rank] = (parts[0], parts[1])
                elif len(merge(piece, self.ranks)) == 1:
                    raise ValueError(f"piece {piece!r} of rank {rank} needs a merge of a higher rank")
        return found

    @cached_property
    def rank_map(self) -> Column:
        """A literal: for every rank the pair it merges, as text ``<id><id>``; empty for a byte."""
        pairs = self.pairs
        return F.split(F.lit(",".join("<%d><%d>" % pairs[i] if i in pairs else "" for i in range(max(self.ranks.values()) + 1))), ",")

    @cached_property
    def names(self) -> Column:
        """A literal: for every rank the text of its piece, ``<id>``."""
        return F.split(F.lit(",".join(f"<{i}>" for i in range(max(self.ranks.values()) + 1))), ",")

    @cached_property
    def pieces(self) -> Column:
        """A literal: hexadecimal digits of the piece of every id, empty for an id without one."""
        by_id = {rank: piece.hex() for piece, rank in self.ranks.items()}
        return F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")


def spans(characters: str) -> str:
    """Ranges of code points for a character class."""
    codes = np.array(sorted(map(ord, characters)))
    starts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    ends = np.append(starts[1:], len(codes)) - 1
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(starts, ends, strict=True))


def merge(word: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[int]:
    """Ids of one word by merges of ranks under ``below``, in plain Python: to find the pairs of a vocabulary, and for the rare long word whose windows never agree."""
    ends = list(range(1, len(word) + 1))  # end of the piece that starts here
    before = list(range(-1, len(word) - 1))  # start of the piece before
    heap = [(ranks[word[i:i + 2]], i, i + 1, i + 2) for i in range(len(word) - 1) if ranks.get(word[i:i + 2], below) < below]
    heapify(heap)
    alive = [True] * len(word)
    while heap:
        _, start, middle, end = heappop(heap)
        if not (alive[start] and ends[start] == middle and middle < len(word) and alive[middle] and ends[middle] == end):
            continue
        ends[start], alive[middle] = end, False
        if end < len(word):
            before[end] = start
            if (rank := ranks.get(word[start:ends[end]], below)) < below:
                heappush(heap, (rank, start, end, ends[end]))
        if start > 0 and (rank := ranks.get(word[before[start]:end], below)) < below:
            heappush(heap, (rank, before[start], start, end))
    ids, at = [], 0
    while at < len(word):
        ids.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return ids


def merged_ids(vocabulary: Vocabulary, single: Column, merges: Column) -> Column:
    """Ids of a word from its bytes' ids as text ``<id><id>...`` and the ascending ranks to merge, by a fold over these.

    A merge replaces its pair from left to right wherever it stands.
    """
    text = F.aggregate(merges, single, lambda text, rank: F.replace(text, F.get(vocabulary.rank_map, rank), F.get(vocabulary.names, rank)))
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)).cast("array<int>")


class Words:
    """Distinct words of a stretch of documents, numbered as they come."""

    def __init__(self, splitters: tuple[str, str], ranks: dict[bytes, int], mergeable: frozenset[int], window: int):
        self.cut, self.cut_any = (re.compile(s).findall for s in splitters)
        self.ranks, self.window = ranks, window
        self.single = [f"<{ranks[bytes([i])]}>" for i in range(256)]
        self.found = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            if rank in mergeable:
                self.found.add_word(piece.decode("latin-1"), rank)
        self.found.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.long: dict[str, list[int]] = {}
        self.n = self.characters = 0
        self.sent()

    def sent(self) -> None:
        """Starts a new list of new words: bytes, and the flat ranks with the number per word."""
        self.new: list[str | None] = []
        self.merges: list[int] = []
        self.sizes: list[int] = []

    def code(self, part: bytes) -> int:
        merges = sorted({r for _, r in self.found.iter(part.decode("latin-1"))}) if len(self.found) else []
        return self.row("".join(map(self.single.__getitem__, part)), merges)

    def row(self, single: str | None, ranks: list[int]) -> int:
        """Bytes and merges of a word, or no bytes and its ids."""
        self.new.append(single)
        self.merges += ranks
        self.sizes.append(len(ranks))
        self.n += 1
        return self.n - 1

    def add(self, word: str) -> None:
        data = word.encode()
        self.characters += len(word)
        if data in self.ranks:
            self.codes[word] = self.row(None, [self.ranks[data]])
        elif len(data) > self.window:
            half = self.window // 2
            self.long[word] = [self.code(data[i:i + self.window]) for i in range(0, len(data) - half, half)]
            self.codes[word] = -1
        else:
            self.codes[word] = self.code(data)

    def __call__(self, text: str) -> list[int]:
        """Codes of the words of a text; a word in windows is -1, their number and their codes."""
        words = (self.cut if text.isascii() or max(text) < "\U00010000" else self.cut_any)(text)
        for word in dict.fromkeys(words):
            if word not in self.codes:
                self.add(word)
        found = list(map(self.codes.__getitem__, words))
        if not self.long or -1 not in found:
            return found
        spread: list[int] = []
        for word, code in zip(words, found, strict=True):
            spread += [code] if code >= 0 else [-1, len(self.long[word]), *self.long[word]]
        return spread


class Joiner:
    """Ids of documents from the ids of words."""

    def __init__(self, ranks: dict[bytes, int], window: int):
        self.ranks, self.half = ranks, window // 2
        by_id = {rank: piece for piece, rank in ranks.items()}
        self.by_id = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(p) for p in self.by_id])
        self.forget()

    def forget(self) -> None:
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def word(self, code: int) -> np.ndarray:
        return self.ids[self.ends[code]:self.ends[code + 1]]

    def whole(self, windows: list[np.ndarray]) -> np.ndarray:
        """Ids of a long word. Two windows are joined at a token that both have: neighbours that are right in a window are right in the word."""
        taken, begin = [], 0
        for i, (here, there) in enumerate(zip(windows, windows[1:], strict=False)):
            ends, others = i * self.half + np.cumsum(self.lengths[here]), (i + 1) * self.half + np.cumsum(self.lengths[there])
            size = 4 * self.half * (len(windows) + 1)  # start and end of a token as one number
            _, a, b = np.intersect1d((ends - self.lengths[here]) * size + ends, (others - self.lengths[there]) * size + others, return_indices=True)
            if not len(a):
                parts = [b"".join(self.by_id[t] for t in w) for w in windows]
                return np.array(merge(b"".join([p[:self.half] for p in parts[:-1]] + parts[-1:]), self.ranks), np.int32)
            at = len(a) // 2
            taken.append(here[begin:a[at] + 1])
            begin = b[at] + 1
        return np.concatenate([*taken, windows[-1][begin:]])

    def plain(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one behind the other, and how many each has."""
        starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)], sizes

    def __call__(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents given as the codes of their words, and how many each document has."""
        if not len(codes) or codes.min() >= 0:
            ids, per_word = self.plain(codes)
            return ids, np.bincount(np.repeat(np.arange(len(sizes)), sizes), per_word, len(sizes)).astype(np.int64)
        done = [self.with_windows(part.tolist()) for part in np.split(codes, np.cumsum(sizes)[:-1])]
        return np.concatenate(done), np.array([len(d) for d in done], np.int64)

    def with_windows(self, codes: list[int]) -> np.ndarray:
        parts, at = [np.zeros(0, np.int32)], 0
        while at < len(codes):
            if codes[at] >= 0:
                parts.append(self.word(codes[at]))
                at += 1
            else:
                n = codes[at + 1]
                parts.append(self.whole([self.word(c) for c in codes[at + 2:at + 2 + n]]))
                at += 2 + n
        return np.concatenate(parts)


def offsets(sizes: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def encode(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs``, in which a null text counts as empty and has no ids.

    Repeated rows stay rows of their own; no rows give no rows; columns other than doc_id and text are ignored. A word of any
    length is encoded: beyond ``window`` bytes in overlapping windows. A task remembers up to ``remembered`` distinct words
    before it starts anew, which bounds its memory and not the result.
    """
    splitters, ranks, mergeable = vocabulary.splitters, vocabulary.ranks, frozenset(vocabulary.pairs)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(splitters, ranks, mergeable, window)
        for batch in batches:
            ids = batch.column("doc_id")
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                fresh, codes, lengths = words.n == 0, [], []
                for text in batch.column("text").slice(at, DOCUMENTS_AT_ONCE).to_pylist():
                    found = words(text or "")
                    codes += found
                    lengths.append(len(found))
                n, m = len(words.new), len(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.concat_arrays([pa.nulls(n, ids.type), ids.slice(at, DOCUMENTS_AT_ONCE)]),
                    "is_doc": pa.array(np.arange(n + m) >= n),
                    "codes": pa.ListArray.from_arrays(offsets([0] * n + lengths), pa.array(codes, pa.int32())),
                    "single": pa.array(words.new + [None] * m, pa.string()),
                    "ranks": pa.ListArray.from_arrays(offsets(words.sizes + [0] * m), pa.array(words.merges, pa.int32())),
                    "fresh": pa.array([fresh] + [False] * (n + m - 1), pa.bool_())})
                words.sent()
                if words.n > remembered or words.characters > REMEMBERED_CHARACTERS:
                    words.forget()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(ranks, window)
        for whole in batches:
            starts = np.flatnonzero(whole.column("fresh").to_numpy(zero_copy_only=False)).tolist()
            for first, last in zip([0, *starts], [*starts, whole.num_rows], strict=True):
                if first in starts:
                    joiner.forget()
                batch = whole.slice(first, last - first)
                is_doc = batch.column("is_doc").to_numpy(zero_copy_only=False)
                lists, codes = batch.column("ids"), batch.column("codes")
                joiner.learn(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())[~is_doc])
                found, sizes = joiner(codes.flatten().to_numpy(), np.diff(codes.offsets.to_numpy())[is_doc])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").filter(pa.array(is_doc)),
                    "ids": pa.ListArray.from_arrays(offsets(sizes), pa.array(found.astype(np.int32)))})

    rows = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, is_doc boolean, codes array<int>, single string, ranks array<int>, fresh boolean")
    ids = F.when(F.col("single").isNull(), F.col("ranks")).otherwise(merged_ids(vocabulary, F.col("single"), F.col("ranks")))
    return rows.select("doc_id", "is_doc", "codes", "fresh", ids.alias("ids")).mapInArrow(join, f"doc_id {id_type}, ids array<int>")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of a list of ids: their pieces, one behind the other. An id without a piece adds nothing."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocabulary.pieces, i)), ""))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: digests of the ids and of the bytes decoded from them."""
    coded = encode(docs, vocabulary)
    json = F.to_json("ids")
    listed = F.substring(json, F.lit(2), F.length(json) - 2)  # without the brackets
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))
