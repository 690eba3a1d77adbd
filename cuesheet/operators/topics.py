"""Topic models: one per document, all documents in one plan, or one of the whole corpus.

Variational Bayes in rounds. A line's mixture is found by fixed-point steps from its term counts and the topics of its
document; a document's topics are then the expected counts of its terms. Documents up to a bound of entries come together
whole, many to a batch, and run all rounds in the task that holds them: one shuffle for all models. The topics of larger
documents are a table (document, term, one weight per topic), their lines stay together in blocks: each round sends the
weights of a block's terms to it, once a term, and sums the expected counts that blocks give back. Both ways share the arithmetic and give the same mixtures. A corpus is one
large document in this sense, so its topics are such a table too, and neither terms nor topics pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.functions.wordlists import STOP_WORDS
from cuesheet.operators import skew, tfidf
from cuesheet.operators.collections import ENTRIES_PER_TASK, Batch, Collection, in_documents
from cuesheet.session import materialise

ROWS_PER_SALT = 250_000
ENTRIES_PER_BLOCK = 4 * ROWS_PER_SALT
LINE_STEPS, LINE_TOLERANCE = 100, 1e-3
ENTRIES_IN_CACHE = 1 << 14


@dataclass(frozen=True)
class Settings:
    """Both priors default to one over the number of topics."""

    topics: int = 5
    rounds: int = 10
    seed: int = 42
    line_prior: float | None = None
    term_prior: float | None = None

    @property
    def alpha(self) -> float:
        return 1 / self.topics if self.line_prior is None else self.line_prior

    @property
    def eta(self) -> float:
        return 1 / self.topics if self.term_prior is None else self.term_prior


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for positive arguments, by its series beyond 8."""
    shift, y = np.zeros_like(x), x.copy()
    while (low := y < 8).any():
        shift[low] -= 1 / y[low]
        y[low] += 1
    z = 1 / (y * y)
    return shift + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def first_weights(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Weights around 1 that tell the topics apart, a function of term, topic and seed alone."""
    out = np.empty((len(hashes), s.topics))
    for k in range(s.topics):
        with np.errstate(over="ignore"):
            z = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (k + 1 + 131 * s.seed)) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = 0.7 + 0.6 * ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return out


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """Exponential of the digamma function for positive arguments: eight shifts in one fraction, then its series."""
    t = x * (x + 7)  # 1/x + 1/(x + 7) = (2x + 7) / t, and so on inwards with t + 6, t + 10, t + 12
    p, q = t * (t + 6), (t + 10) * (t + 12)
    shift = (2 * x + 7) * ((2 * t + 6) * q + (2 * t + 22) * p) / (p * q)
    y = x + 8
    u = 1 / y
    z = u * u
    return y * np.exp(-shift - 0.5 * u - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))))


def _fixed_points(counts: np.ndarray, at: np.ndarray, weights: np.ndarray, n_lines: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures of some lines and their shares up to a factor for each line, topic by topic."""
    mixture = np.ones((s.topics, n_lines))
    share = exp_digamma(mixture)
    lines, moving, mine, last = np.arange(n_lines), np.ones(n_lines, bool), share, mixture.copy()
    for _ in range(LINE_STEPS):
        norm = np.full(len(at), 1e-100)
        for k in range(s.topics):
            norm += mine[k].take(at, mode="clip") * weights[k]  # without the check of bounds, which takes most of the time
        pull = counts / norm
        fresh = np.stack([mine[k] * np.bincount(at, pull * weights[k], len(lines)) for k in range(s.topics)]) + s.alpha
        mine = exp_digamma(fresh)
        mixture[:, lines[moving]], share[:, lines[moving]] = fresh[:, moving], mine[:, moving]
        moving = moving & (np.abs(fresh - last).mean(0) >= LINE_TOLERANCE)
        last, left = fresh, int(moving.sum())
        if not left:
            break
        if left < 0.8 * len(lines):  # stopped lines go from time to time
            stays, number = moving[at], np.cumsum(moving) - 1
            at, counts, weights = number[at[stays]], counts[stays], weights[:, stays]
            lines, mine, last, moving = lines[moving], mine[:, moving], last[:, moving], np.ones(left, bool)
    return mixture, share


def line_mixtures(counts: np.ndarray, line_of: np.ndarray, weights: np.ndarray, n_lines: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Topic counts of every line and expected topic counts of every entry.

    Entries are (line, term) pairs in the order of their lines; ``weights`` holds the exponentiated topic weights of the
    entry's term. A line stops by itself when its mixture moves less than the tolerance, so a line's result does not depend
    on the other lines of a batch; so many lines are solved at a time as fit a processor's cache.
    """
    mixture, found = np.ones((n_lines, s.topics)), np.empty((len(line_of), s.topics))
    heads = np.append(np.unique(line_of[::ENTRIES_IN_CACHE]), n_lines) if len(line_of) else np.zeros(0, np.int64)
    for first, last in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        a, b = np.searchsorted(line_of, [first, last])
        at, w = line_of[a:b] - first, np.ascontiguousarray(weights[a:b].T)
        mixed, share = _fixed_points(counts[a:b], at, w, last - first, s)
        mixture[first:last] = mixed.T
        parts = [share[k].take(at, mode="clip") * w[k] for k in range(s.topics)]
        part = counts[a:b] / (sum(parts) + 1e-100)
        for k in range(s.topics):
            found[a:b, k] = parts[k] * part
    return mixture, found


def entry_weights(topics: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.exp(digamma(topics) - digamma(totals))


def line_bags(line_table: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """``(doc_id, line, words, copies)``: distinct bags of terms of every document; ``line`` is a digest of the bag."""
    words = F.sort_array(F.coalesce(text.without(text.terms(F.col("line")), stop_words), F.array().cast("array<string>")))
    bags = line_table.select("doc_id", words.alias("words")).groupBy("doc_id", "words").agg(F.count(F.lit(1)).alias("copies"))
    return materialise(bags.withColumn("line", F.md5(F.concat_ws("\x1f", "words"))))


def _list_of(values: np.ndarray) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.reshape(-1)))


def fit_whole(whole: DataFrame, s: Settings, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, topic_distribution)``: mean mixtures of the lines of gathered documents, all rounds in the task that holds them."""
    def fit(b: Batch) -> pa.RecordBatch:
        order = np.argsort(b.line_of, kind="stable")
        line, term_of, counts, copies = b.line_of[order], b.term_of[order], b.tf[order].astype(float), b.copies[b.line_of[order]]
        held, line_of = np.unique(line, return_inverse=True)  # lines without terms are even
        topics, owner = first_weights(b.hashes, s), b.doc_of_term

        def expected() -> tuple[np.ndarray, np.ndarray]:
            totals = np.stack([np.bincount(owner, topics[:, k], b.n_docs) for k in range(s.topics)], 1)
            return line_mixtures(counts, line_of, entry_weights(topics, totals[owner])[term_of], len(held), s)

        for _ in range(s.rounds):
            _, found = expected()
            topics = s.eta + np.stack([np.bincount(term_of, found[:, k] * copies, len(owner)) for k in range(s.topics)], 1)
        mixture, _ = expected()
        part = mixture / mixture.sum(1)[:, None] * b.copies[held][:, None]
        total = np.stack([np.bincount(b.doc_of_line[held], part[:, k], b.n_docs) for k in range(s.topics)], 1)
        empty = b.n_lines - np.bincount(b.doc_of_line[held], b.copies[held], b.n_docs)
        return pa.RecordBatch.from_arrays([b.ids, _list_of((total + empty[:, None] / s.topics) / b.n_lines[:, None])], ["doc_id", "topic_distribution"])

    hashed = whole.withColumn("lines", F.transform("lines", lambda x: x.withField("terms", F.transform(x["terms"], lambda t: F.struct(
        t["term"].alias("term"), t["tf"].alias("tf"), F.xxhash64(t["term"]).alias("hash"))))))
    return in_documents(hashed, fit, "topic_distribution array<double>", stop_words)


def _sums(column: str, k: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(k)])


def blocks_of(bags: DataFrame, entries_per_block: int) -> DataFrame:
    """``(block, terms, docs, lines, copies, sizes, slots, counts)``: the bags that have terms, some ``entries_per_block`` words at a time.

    ``terms`` are the distinct (doc_id, term) of a block by number; ``docs``, ``lines``, ``copies`` and ``sizes`` belong to
    its lines; ``slots`` and ``counts`` to the entries of one line after the other: the number of a term and how often it occurs.
    """
    id_type = bags.schema["doc_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        docs, lists = (t.column(c).chunk(0) for c in ("doc_id", "words"))
        words, owners = lists.flatten().dictionary_encode(), docs.dictionary_encode()
        line_of = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        size = len(words.dictionary)
        pairs, pair_of = np.unique(owners.indices.to_numpy()[line_of].astype(np.int64) * size + words.indices.to_numpy(), return_inverse=True)
        found, counts = np.unique(line_of * len(pairs) + pair_of, return_counts=True)
        terms = pa.StructArray.from_arrays([owners.dictionary.take(pa.array(pairs // size)), words.dictionary.take(pa.array(pairs % size))], ["doc_id", "term"])

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        held = (terms, docs, t.column("line").chunk(0), t.column("copies").chunk(0),
                *(pa.array(x.astype(np.int32)) for x in (np.bincount(found // len(pairs), minlength=t.num_rows), found % len(pairs), counts)))
        return pa.table([t.column("block").chunk(0)[:1], *map(one, held)], ["block", "terms", "docs", "lines", "copies", "sizes", "slots", "counts"])

    filled = bags.where(F.size("words") > 0)
    n = max(1, -(-(filled.agg(F.sum(F.size("words"))).first()[0] or 0) // entries_per_block))
    dealt = filled.select(F.pmod(F.xxhash64("doc_id", "line"), F.lit(n)).alias("block"), "doc_id", "line", "copies", "words")
    return materialise(dealt.groupBy("block").applyInArrow(
        pack, f"block bigint, terms array<struct<doc_id: {id_type}, term: string>>, docs array<{id_type}>, lines array<string>, "
              "copies array<bigint>, sizes array<int>, slots array<int>, counts array<int>"))


def fit_in_rounds(bags: DataFrame, s: Settings, entries_per_block: int = ENTRIES_PER_BLOCK) -> DataFrame:
    """``(doc_id, line, copies, mixture)`` of bags with terms, for documents of any size: the topics are a table.

    The lines stay together in blocks. In every round a block gets the topics of its terms and gives one sum per term back,
    so what is shuffled are the terms of blocks, not the entries of lines, and a term comes once per block at most.
    """
    id_type = bags.schema["doc_id"].dataType.simpleString()
    keys, rows = ["doc_id", "term"], f"doc_id {id_type}, term string, topics array<double>"
    blocks = blocks_of(bags, entries_per_block)
    used = materialise(blocks.select("block", F.posexplode("terms").alias("slot", "t")).select("block", "slot", "t.*"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_of(first_weights(b.column(2).to_numpy(), s))], ["doc_id", "term", "topics"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topics, totals = (b.column(c).flatten().to_numpy().reshape(-1, s.topics) for c in ("topics", "totals"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_of(entry_weights(topics, totals))], ["doc_id", "term", "topics"])

    def solved(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(batch.num_rows):
            b = {c: batch.column(c)[i].values for c in batch.schema.names if c != "block"}
            line_of = np.repeat(np.arange(len(b["lines"])), b["sizes"].to_numpy())
            weights = b["weights"].field("topics").flatten().to_numpy().reshape(-1, s.topics)[b["slots"].to_numpy()]
            yield b, line_of, *line_mixtures(b["counts"].to_numpy().astype(float), line_of, weights, len(b["lines"]), s)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, line_of, _, found in solved(batch):
                found, slots = found * b["copies"].to_numpy()[line_of][:, None], b["slots"].to_numpy()
                sums = np.stack([np.bincount(slots, found[:, k], len(b["terms"])) for k in range(s.topics)], 1)
                yield pa.RecordBatch.from_arrays([b["terms"].field("doc_id"), b["terms"].field("term"), _list_of(sums)], ["doc_id", "term", "topics"])

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, mixture, _ in solved(batch):
                part = _list_of(mixture / mixture.sum(1)[:, None])
                yield pa.RecordBatch.from_arrays([b["docs"], b["lines"], b["copies"], part], ["doc_id", "line", "copies", "mixture"])

    def blocks_with(topics: DataFrame) -> DataFrame:
        totals = topics.groupBy("doc_id").agg(_sums("topics", s.topics).alias("totals"))
        weights = skew.lookup(topics, totals, ["doc_id"], ["term"], "inner").select(*keys, "topics", "totals").mapInArrow(weigh, rows)
        sent = used.join(weights.hint("merge"), keys).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "topics"))).alias("weights"))
        return blocks.join(sent.hint("merge"), "block")

    topics = materialise(used.select(*keys).distinct().withColumn("hash", F.xxhash64("term")).mapInArrow(begin, rows))
    for _ in range(s.rounds):
        sums = blocks_with(topics).mapInArrow(expect, rows).groupBy(*keys).agg(_sums("topics", s.topics).alias("topics"))
        topics = materialise(sums.withColumn("topics", F.transform("topics", lambda x: x + F.lit(s.eta))))
    return blocks_with(topics).mapInArrow(mix, f"doc_id {id_type}, line string, copies bigint, mixture array<double>")


def _means(bags: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Mean mixtures from the summed mixtures of lines with terms; the other lines are even."""
    sizes = bags.groupBy("doc_id").agg(F.sum("copies").alias("lines"), F.sum(F.when(F.size("words") == 0, F.col("copies")).otherwise(0)).alias("empty"))
    none = F.array_repeat(F.lit(0.0), k)
    return sizes.join(totals.hint("merge"), "doc_id", "left").select("doc_id", F.transform(
        F.coalesce("total", none), lambda t: (t + F.col("empty") / k) / F.col("lines")).alias("topic_distribution"))


def _weighted_sums(mixed: DataFrame, k: int) -> DataFrame:
    return mixed.groupBy("doc_id").agg(F.array(*[F.sum(F.col("mixture")[i] * F.col("copies")) for i in range(k)]).alias("total"))


def document_topics(line_table: DataFrame, settings: Settings = Settings(), stop_words: Sequence[str] = tuple(STOP_WORDS),
                    entries_per_task: int = ENTRIES_PER_TASK, rows_per_salt: int = ROWS_PER_SALT, lines: Collection | None = None) -> DataFrame:
    """``(doc_id, topic_distribution)``: mean mixture of a document's lines under the document's own topics.

    A line without terms, also a null one, counts as an even mixture, so a document of such lines is even. Lines with equal
    bags of terms are one line with copies. No rows give no rows. A document that may have more than ``entries_per_task``
    different (line, term) entries is fitted as a table.
    """
    s = settings
    lines = lines or tfidf.collection(line_table, entries_per_task)
    found = fit_whole(lines.whole, s, stop_words)
    if lines.large is None:
        return found
    bags = line_bags(lines.large, stop_words)
    return found.unionByName(_means(bags, _weighted_sums(fit_in_rounds(bags, s, 4 * rows_per_salt), s.topics), s.topics))


def corpus_topics(line_table: DataFrame, settings: Settings = Settings(), stop_words: Sequence[str] = tuple(STOP_WORDS),
                  rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(doc_id, topic_distribution)``: mean mixture of a document's lines under topics of all documents' lines.

    A topic means the same in every row. The topics are a table by term, so any number of terms will do. Equal lines of all
    documents are one line with copies.
    """
    s = settings
    bags = line_bags(line_table, stop_words)
    lines = bags.groupBy("line").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    lines = materialise(lines.withColumn("doc_id", F.lit(0)))
    mixed = materialise(fit_in_rounds(lines, s, 4 * rows_per_salt).select("line", "mixture"))
    met = skew.salted_lookup(bags.select("doc_id", "line", "copies"), mixed, ["line"], lines.select("line", "n"), "n", ["doc_id"])
    return _means(bags, _weighted_sums(met, s.topics), s.topics)


def topic_distribution(line_table: DataFrame, n_topics: int = 5, seed: int = 42, max_iter: int = 10, stop_words: Sequence[str] = tuple(STOP_WORDS),
                       per_document: bool = False, lines: Collection | None = None) -> DataFrame:
    """Mean topic mixture of each document's lines, under topics of the corpus or of the document itself."""
    settings = Settings(n_topics, max_iter, seed)
    return document_topics(line_table, settings, stop_words, lines=lines) if per_document else corpus_topics(line_table, settings, stop_words)
