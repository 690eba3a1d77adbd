"""Secrets in texts: fixed patterns, and values in a credential context that would cost many guesses.

Three patterns give the base spans. Beside them, every value that a credential word introduces is priced: dynamic
programming finds its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and brute-force
characters, and the guesses of the segments multiply. Values at or above the bound become spans of the kind ``guess``;
an everyday word behind "token:" is cheap and does not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they must catch, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a shorter run fails anyway, and runs are maximal
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "pin", "kennwort",
                 "contrase", "clave", "mot de passe")
CONTEXT = re.compile(
    r"""(?<![^\W\d_])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|client|secret|auth)[_-](?:key|token|secret)
    |credentials?|authorization|bearer|login|pin|kennwort|passwort|contrase(?:ñ|n)a|clave|mot\x20de\x20passe)
    ["']?\s*(?:=>|[:=]|\b(?:is|was|ist|es|est)\b)\s*
    (?:(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\r\n]){4,})(?P=quote)(?!\w)|["'`]?(?P<bare>[^\s"'`,;<>(){}\[\]|]{4,}))""", re.I | re.X)

MIN_LOG_GUESSES = 9.0
LONGEST_WORD = 32
COMMON = ("password 123456 12345678 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess "
          "football baseball shadow superman trustno1 changeme secret default root guest test hello user pass example").split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("430157$@!", "aeoistsai")
DATE = re.compile(
    r"(?:19|20)\d\d([-./_]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-./_]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)|(?:19|20)\d\d")
DATE_LEAST, DATE_MOST = 4, 10


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch: beside each other in a row, or above and below with the usual offset."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c - 1), (r, c + 1), (r + 1, c - 1), (r + 1, c), (r - 1, c), (r - 1, c + 1)):
                if 0 <= rr < len(KEY_ROWS) and 0 <= cc < len(KEY_ROWS[rr]):
                    near.setdefault(key, set()).add(KEY_ROWS[rr][cc])
    return near


NEAR = _neighbours()
DEGREE = sum(map(len, NEAR.values())) / len(NEAR)


def model_words(model_path: str) -> dict[str, int]:
    """Ranked words: a short list of common passwords, then the whole-word pieces of a tokenizer, frequent ones first."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()))
    words = [p[1:].lower() for p in pieces if p.startswith("▁") and len(p) > 3 and p[1:].isalpha()]
    ranks: dict[str, int] = {}
    for w in [*COMMON, *words]:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks


def character_cost(c: str) -> float:
    if c.isdigit() and c.isascii():
        return 1.0
    if c.isascii() and c.isalpha():
        return log10(26)
    return log10(33) if c.isascii() else 2.0


def repeat_runs(text: str, longest: int) -> list[tuple[int, int, int]]:
    """``(start, end, size)`` of the widest stretches that repeat with a period of ``size``, at least twice.

    Such a stretch holds a multiple of the period that agrees with the next one, so only those are looked at. Periods
    beyond the longest word that are multiples of a shorter one of the same stretch are left out: their unit is a repeat.
    """
    n, runs = len(text), []
    for size in range(1, n // 2 + 1):
        at = 0
        while at + size < n:
            if text[at] != text[at + size]:
                at += size
                continue
            known = next((e for s, e, p in runs if size > longest and size % p == 0 and s <= at and at + size + p <= e), None)
            if known is not None:
                at += (max(known - size - at, 1) + size - 1) // size * size
                continue
            start, end = at, at + size
            while start and text[start - 1] == text[start - 1 + size]:
                start -= 1
            while end < n and text[end] == text[end - size]:
                end += 1
            if end - start >= 2 * size:
                runs.append((start, end, size))
            at += (max(end - size - at, 1) + size - 1) // size * size
    return runs


def walks(text: str) -> tuple[list[int], np.ndarray]:
    """Where the keyboard walk that ends before each place begins, and how often the direction changed up to each step."""
    lower = [c.lower() for c in text]
    since, changes, last = [0] * (len(text) + 1), np.zeros(max(len(text), 1), np.int64), None
    for j in range(1, len(text) + 1):
        since[j] = j - 1
        if j > 1 and lower[j - 1] in NEAR.get(lower[j - 2], ()):
            a, b = lower[j - 2], lower[j - 1]
            step = ord(b) - ord(a) if a.isdigit() else KEY_ROWS_AT[b] - KEY_ROWS_AT[a]
            since[j] = since[j - 1]
            changes[j - 2] = (changes[j - 3] if j > 2 else 0) + (step != last)
            last = step
        elif j > 1:
            changes[j - 2], last = changes[j - 3] if j > 2 else 0, None
    return since, changes


class GuessCost:
    """Logarithm (base 10) of the guesses that the cheapest segmentation of a value needs."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.longest = min(LONGEST_WORD, max(map(len, ranks), default=0))

    def word(self, text: str) -> float | None:
        lower = text.lower()
        plain = lower.translate(LEET)
        rank = self.ranks.get(lower) or self.ranks.get(plain)
        if rank is None:
            return None
        swapped = sum(a != b for a, b in zip(lower, plain, strict=True)) if lower not in self.ranks else 0
        capitals = sum(c.isupper() for c in text)
        case = 0.0 if not capitals else log10(2) if capitals in (1, len(text)) and (text[0].isupper() or capitals > 1) else capitals * log10(2) + 0.5
        return log10(rank + 1) + swapped * log10(2) + case

    def repeat(self, unit: str) -> float | None:
        """Cost of the unit of a repeat; None where a shorter unit is never dearer."""
        word = self.word(unit)
        if word is None and (unit + unit).find(unit, 1) < len(unit):
            return None
        own = sum(map(character_cost, unit))
        return own if word is None else min(word, own)

    def spans(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Segments other than single brute-force characters: ``(start, end, cost)``."""
        yield from self._plain_spans(text)
        for start, end, size in repeat_runs(text, self.longest):
            for i in range(start, end - 2 * size + 1):
                if (unit := self.repeat(text[i:i + size])) is not None:
                    for times in range(2 if size > 1 else 3, (end - i) // size + 1):
                        yield i, i + times * size, unit + log10(times)
        since, changes = walks(text)
        for j in range(len(text) + 1):
            for i in range(since[j], j - 2):
                yield i, j, float(self.walk(j - i, 1 + changes[j - 2] - changes[i]))

    @staticmethod
    def walk(length: np.ndarray | int, turns: np.ndarray | int) -> np.ndarray | float:
        return log10(len(NEAR)) + turns * np.log10(DEGREE * length / turns)

    def _plain_spans(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Words and dates."""
        for i in range(len(text)):
            for j in range(i + 3, min(len(text), i + self.longest) + 1):
                cost = self.word(text[i:j])
                if cost is not None:
                    yield i, j, cost
        for i in range(len(text)):
            if text[i].isdigit():
                for j in range(i + DATE_LEAST, min(len(text), i + DATE_MOST) + 1):
                    if DATE.fullmatch(text, i, j):
                        digits = sum(c.isdigit() for c in text[i:j])
                        yield i, j, (2.1 if digits == 4 else log10(365 * 100)) + (0.6 if digits < j - i else 0.0)

    def segments(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Least cost and the segmentation that has it; each segment after the first doubles the guesses.

        Repeats are not listed one by one. Those of one unit that end at the same place differ in their start only, and the
        advantage of a later start, fewer times, shrinks as the end moves on: a start that an earlier one has matched is dropped.
        """
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for i, j, cost in self._plain_spans(text):
            ending[j].append((i, cost + log10(2)))
        opening: dict[int, list[tuple[int, int, int, dict]]] = {}
        for start, end, size in repeat_runs(text, self.longest):
            opening.setdefault(start + 2 * size, []).append((start, end, size, {}))
        running: list[tuple[int, int, int, dict]] = []
        since, changes = walks(text)
        best, back = [0.0], [0]
        for j in range(1, len(text) + 1):
            options = [(best[j - 1] + character_cost(text[j - 1]), j - 1), *((best[i] + cost, i) for i, cost in ending[j])]
            if j - since[j] >= 3:
                i = np.arange(since[j], j - 2)
                prices = np.array(best[since[j]:j - 2]) + self.walk(j - i, 1 + changes[j - 2] - changes[i])
                options.append((float(prices.min()) + log10(2), int(i[prices.argmin()])))
            running = [r for r in running if r[1] >= j] + opening.get(j, [])
            for start, _, size, lanes in running:
                starts, unit = lanes.setdefault(j % size, ([], self.repeat(text[j - size:j])))
                least = 2 if size > 1 else 3
                if unit is None or j - least * size < start:
                    continue
                starts.append(j - least * size)
                prices = [best[i] + log10((j - i) // size) for i in starts]
                at = prices.index(min(prices))
                del starts[at + 1:]
                options.append((prices[at] + unit + log10(2), starts[at]))
            cost, i = min(options)
            best.append(cost)
            back.append(i)
        cuts, at = [], len(text)
        while at:
            cuts.append((back[at], at))
            at = back[at]
        return best[-1], cuts[::-1]

    def __call__(self, text: str) -> float:
        return self.segments(text)[0]


KEY_ROWS_AT = {key: 100 * r + c for r, row in enumerate(KEY_ROWS) for c, key in enumerate(row)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind, without those that are too short."""
    found = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def priced_values(text: str, cost: GuessCost) -> list[tuple[int, int, float]]:
    """Values in a credential context with the logarithm of their guesses.

    A quoted value reaches to its closing quote in the line. Without one it ends at white space or at what separates values
    in lists, calls and markup, and closing punctuation is not part of it.
    """
    folded = text.lower()
    if not any(w in folded for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        part = "bare" if m["quoted"] is None else "quoted"
        value = m[part].rstrip(".:!?") if part == "bare" else m[part]
        if len(value) >= 4:
            out.append((m.start(part), m.start(part) + len(value), cost(value)))
    return out


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str, cost: GuessCost, least: float = MIN_LOG_GUESSES) -> tuple[list, list, float | None]:
    """Base spans, all spans, and the largest logarithm of guesses of a value. A value inside a base span adds none."""
    base, values = base_spans(text), priced_values(text, cost)
    added = [(a, b, "guess") for a, b, c in values if c >= least and not any(x <= a and b <= y for x, y, _ in base)]
    every = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))
    return base, every, max((c for *_, c in values), default=None)


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, max_log_guesses double"


def find_secrets(docs: DataFrame, ranks: dict[str, int], least: float = MIN_LOG_GUESSES) -> DataFrame:
    """One row per row of ``documents``, scanned whole: counts, digest of the base spans, and all spans as
    ``kind:start:end`` in code points, end exclusive.

    A null text counts as empty: no spans, and the digest of nothing. Repeated rows are reported each, no rows give no
    rows, a null doc_id stays null, other columns are ignored. ``max_log_guesses`` is null where no credential context
    is found. ``ranks`` is the word list; it is sent to every task, so it must be of bounded size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(ranks)
        for batch in batches:
            rows = [scan(t or "", cost, least) for t in batch.column("text").to_pylist()]
            counts = [[sum(k == kind for *_, k in every) for _, every, _ in rows] for kind in KINDS]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, *_ in rows]),
                pa.array([joined(every) for _, every, _ in rows]), pa.array(counts[3], pa.int64()),
                pa.array([top for *_, top in rows], pa.float64()),
            ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_log_guesses"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RESULT)
