"""The lines of whole documents, gathered once, and their term weights inside the task that holds them.

Every document is its own collection, so a document that fits a task needs no join: its lines come together in one shuffle
by document, and term weights, keywords, near-duplicate lines, clusters and topics are found there. A document that may hold
more terms than a task takes keeps its lines as rows and goes the way of tables (``tfidf``, ``clustering``, ``topics``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.session import materialise, written

ENTRIES_PER_TASK, ENTRIES_PER_BATCH = 2_000_000, 200_000


@dataclass
class Collection:
    """``whole``: ``(doc_id, lines)`` with ``lines`` an array of (pos, copies, terms) by pos, ``terms`` one of (term, tf);
    ``large``: ``(doc_id, pos, line)`` of the other documents, None where there are none."""

    whole: DataFrame
    large: DataFrame | None

    def kept(self) -> Collection:
        """Written once, for several readers, by columns: terms repeat, and a checkpoint would hold each of them in full."""
        return Collection(written(self.whole, "gathered"), self.large)


def split_by_size(line_table: DataFrame, entries_per_task: int = ENTRIES_PER_TASK, products_per_task: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Lines of documents that surely fit a task, and of the others. A line of n characters has at most (n + 1) / 3 terms.

    ``products_per_task`` also bounds lines times entries.
    """
    sizes = line_table.groupBy("doc_id").agg(F.sum(F.floor((F.length("line") + 1) / 3) + 1).alias("n"), F.count(F.lit(1)).alias("lines"))
    over = F.col("n") > entries_per_task
    if products_per_task is not None:
        over = over | (F.col("n") * F.col("lines") > products_per_task)
    large = materialise(sizes.where(over).select("doc_id"))
    if large.isEmpty():
        return line_table, None
    named = F.broadcast(large) if skew.is_small(large) else large
    return line_table.join(named, "doc_id", "left_anti"), line_table.join(named, "doc_id", "left_semi")


def gather(profiles: DataFrame, merge: bool = True) -> DataFrame:
    """``(doc_id, lines)`` from ``(doc_id, pos, terms)``; with ``merge``, lines of equal terms are one with copies."""
    rows = profiles.where(F.col("doc_id").isNotNull()).repartition("doc_id")  # one shuffle serves both groupings
    if merge:
        rows = rows.groupBy("doc_id", "terms").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    line = F.struct(F.col("pos").cast("bigint").alias("pos"), "copies", "terms")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@dataclass
class Batch:
    """Some documents as flat arrays: lines by document and pos, entries (line, term) by line, term numbers by document and name."""

    ids: pa.Array
    doc_of_line: np.ndarray
    pos: np.ndarray
    copies: np.ndarray
    line_of: np.ndarray
    term_of: np.ndarray
    tf: np.ndarray
    doc_of_term: np.ndarray
    words: pa.Array
    hashes: np.ndarray | None

    @cached_property
    def n_docs(self) -> int:
        return len(self.ids)

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines of every document, copies counted."""
        return np.bincount(self.doc_of_line, self.copies, self.n_docs)

    @cached_property
    def df(self) -> np.ndarray:
        return np.bincount(self.term_of, self.copies[self.line_of], len(self.doc_of_term)).astype(np.int64)

    def weighted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(line, term, tf, w)`` of the entries, from rare to frequent in each line; every line has length one."""
        order = np.lexsort((self.term_of, self.df[self.term_of], self.line_of))
        line, term, tf = self.line_of[order], self.term_of[order], self.tf[order]
        idf = np.log((1 + self.n_lines[self.doc_of_term]) / (1 + self.df)) + 1
        w = tf * idf[term]
        return line, term, tf, w / np.sqrt(np.bincount(line, w * w, len(self.pos)))[line]

    def of_lines(self, values: Sequence[int] | np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(self.doc_of_line[values]))


def _flat(docs: pa.RecordBatch, stop_words: pa.Array | None) -> Batch:
    lists = docs.column("lines")
    lines = lists.flatten()
    doc_of_line = np.repeat(np.arange(docs.num_rows), np.diff(lists.offsets.to_numpy()))
    bags = lines.field("terms")
    each, line_of = bags.flatten(), np.repeat(np.arange(len(lines)), np.diff(bags.offsets.to_numpy()))
    if stop_words is not None:
        stays = pc.invert(pc.is_in(each.field("term"), value_set=stop_words))
        each, line_of = each.filter(stays), line_of[stays.to_numpy(zero_copy_only=False)]
    codes = each.field("term").dictionary_encode()
    by_name = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    size = max(len(by_name), 1)
    found, head, term_of = np.unique(doc_of_line[line_of] * size + rank[codes.indices.to_numpy()], return_index=True, return_inverse=True)
    hashes = each.field("hash").to_numpy()[head] if each.type.get_field_index("hash") >= 0 else None
    return Batch(docs.column("doc_id"), doc_of_line, lines.field("pos").to_numpy(), lines.field("copies").to_numpy(), line_of, term_of,
                 each.field("tf").to_numpy(), found // size, codes.dictionary.take(pa.array(by_name[found % size])), hashes)


def in_documents(whole: DataFrame, compute: Callable[[Batch], pa.RecordBatch], columns: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` and ``columns`` as ``compute`` gives them for some documents at a time, without the stop words."""
    id_type = whole.schema["doc_id"].dataType.simpleString()
    stop = list(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped = pa.array(stop, pa.string()) if stop else None
        for batch in batches:
            lists = batch.column("lines")
            inner = np.concatenate([[0], np.cumsum(np.diff(lists.flatten().field("terms").offsets.to_numpy()) + 1)])
            ends = inner[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            start = 0
            for i in range(batch.num_rows):
                if i + 1 == batch.num_rows or ends[i + 2] - ends[start] > ENTRIES_PER_BATCH:
                    yield compute(_flat(batch.slice(start, i + 1 - start), dropped))
                    start = i + 1

    return whole.mapInArrow(run, f"doc_id {id_type}, {columns}")
