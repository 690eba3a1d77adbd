"""Term weights of the lines of each document, keywords, and near-duplicate lines.

Every document is its own collection: its lines are the items that are weighted against each other. Lines with the
same terms and frequencies are merged into one *profile* row with a multiplicity before anything is joined, so a
group of copies costs one row however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.functions.vectors import let
from cuesheet.functions.wordlists import STOP_WORDS
from cuesheet.operators import skew
from cuesheet.operators.collections import ENTRIES_PER_TASK, Batch, Collection, gather, in_documents, split_by_size
from cuesheet.session import materialise

EPSILON = 1e-9
#: A key with more lines than this is paired in several tasks.
PAIRED_ROWS_PER_SALT = 20_000
#: Lines of a document are compared inside a task while lines times entries stay below this, so many products at a time.
PRODUCTS_PER_TASK, PRODUCTS_AT_ONCE = 400_000_000, 2_000_000


def _frequencies(words: Column) -> Column:
    """Array of (term, tf), sorted by term, from the run lengths of the sorted words: linear after the sort."""
    def starts(w: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

    def runs(w: Column, s: Column) -> Column:
        return F.transform(s, lambda at, j: F.struct(
            F.get(w, at).alias("term"),
            (F.coalesce(F.get(s, j + 1), F.size(w)) - at).cast("bigint").alias("tf")))

    counted = let(F.sort_array(words), lambda w: let(starts(w), lambda s: runs(w, s)))
    return F.when(F.size(words) > 0, counted).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def line_term_counts(line_table: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, pos, terms)`` where ``terms`` is an array of (term, tf), sorted by term; empty for a line without terms."""
    words = text.without(text.terms(F.col("line")), stop_words)
    return line_table.select("doc_id", "pos", let(words, _frequencies).alias("terms"))


def line_profiles(line_table: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Distinct term profiles: ``(doc_id, pos, copies, terms)``; ``pos`` is the first line that has the profile.

    Written once: term counts, document sizes and weights all read it, and none of them cuts the text again.
    """
    return materialise(line_term_counts(line_table, stop_words).groupBy("doc_id", "terms").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies")))


def weighted_lines(profiles: DataFrame, rows_per_salt: int = skew.ROWS_PER_SALT) -> DataFrame:
    """Weight the terms: tf * (ln((1 + n) / (1 + df)) + 1), scaled to length one per line.

    Returns ``(doc_id, pos, copies, terms)`` with ``terms`` an array of (df, term, w, tf) from rare to frequent. Profiles
    without terms count as lines but have no rows.
    """
    sizes = profiles.groupBy("doc_id").agg(F.sum("copies").alias("n_lines"))
    long = profiles.select("doc_id", "pos", "copies", F.explode("terms").alias("t")).select(
        "doc_id", "pos", "copies", "t.term", "t.tf")
    df = long.groupBy("doc_id", "term").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("_profiles"))
    idf = df.join(sizes, "doc_id").select(
        "doc_id", "term", "df", (F.log((1 + F.col("n_lines")) / (1 + F.col("df"))) + 1).alias("idf"))
    # a term can be no hotter than its document, and documents are counted without cutting the terms out
    longest = profiles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    counts = df if longest > rows_per_salt else None
    met = skew.salted_lookup(long, idf, ["doc_id", "term"], counts, "_profiles", ["pos"], rows_per_salt=rows_per_salt)
    lines = met.groupBy("doc_id", "pos").agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(
        F.struct("df", "term", (F.col("tf") * F.col("idf")).alias("w"), "tf"))).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"]))
    return lines.select("doc_id", "pos", "copies", let(length, lambda n: F.transform("raw", lambda t: t.withField("w", t["w"] / n))).alias("terms"))


def weighted_terms(profiles: DataFrame, rows_per_salt: int = skew.ROWS_PER_SALT) -> DataFrame:
    """The weights of ``weighted_lines`` as rows ``(doc_id, pos, copies, term, df, tf, w)``."""
    return weighted_lines(profiles, rows_per_salt).select("doc_id", "pos", "copies", F.explode("terms").alias("t")) \
        .select("doc_id", "pos", "copies", "t.term", "t.df", "t.tf", "t.w")


def collection(line_table: DataFrame, entries_per_task: int = ENTRIES_PER_TASK, merge: bool = True,
               products_per_task: int | None = None) -> Collection:
    """The lines of every document with their term counts, gathered where the document fits a task."""
    fitting, large = split_by_size(line_table, entries_per_task, products_per_task)
    return Collection(gather(line_term_counts(fitting), merge), large)


def line_tfidf(line_table: DataFrame, stop_words: Sequence[str] = (), entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """Weights per line and term: ``(doc_id, pos, term, weight)``."""
    def rows(b: Batch) -> pa.RecordBatch:
        line, term, _, w = b.weighted()
        return pa.RecordBatch.from_arrays([b.of_lines(line), pa.array(b.pos[line]), b.words.take(pa.array(term)), pa.array(w)],
                                          ["doc_id", "pos", "term", "weight"])

    lines = collection(line_table, entries_per_task, merge=False)
    found = in_documents(lines.whole, rows, "pos bigint, term string, weight double", stop_words)
    if lines.large is None:
        return found
    each = materialise(line_term_counts(lines.large, stop_words).withColumn("copies", F.lit(1).cast("bigint")))
    return found.unionByName(weighted_terms(each).select("doc_id", F.col("pos").cast("bigint"), "term", F.col("w").alias("weight")))


def without_words(profiles: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Profiles without the stop words. Rows that become equal need not be merged: their copies add up later."""
    if not stop_words:
        return profiles
    return profiles.withColumn("terms", F.filter("terms", lambda t: ~t["term"].isin(*stop_words)))


def _ranked_terms(profiles: DataFrame, top_n: int, stop_words: Sequence[str]) -> DataFrame:
    """Keywords over a table of profiles. The rank filter lets each task keep ``top_n`` rows per document before the shuffle."""
    summed = weighted_terms(without_words(profiles, stop_words)).groupBy("doc_id", "term").agg(
        F.round(F.sum(F.col("copies") * F.col("w")), 9).alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "term")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def keyword_lists(line_table: DataFrame, top_n: int = 10, stop_words: Sequence[str] = tuple(STOP_WORDS),
                  lines: Collection | None = None, entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """One array of at most ``top_n`` keywords per document, the largest summed weight first, ties in alphabetical order;
    empty where a document has only stop words."""
    def best(b: Batch) -> pa.RecordBatch:
        line, term, _, w = b.weighted()
        score = np.round(np.bincount(term, b.copies[line] * w, len(b.doc_of_term)), 9)
        order = np.lexsort((np.arange(len(score)), -score, b.doc_of_term))
        size = np.bincount(b.doc_of_term, minlength=b.n_docs)
        first = order[np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < top_n]
        ends = np.concatenate([[0], np.cumsum(np.minimum(size, top_n))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.ids, pa.ListArray.from_arrays(pa.array(ends), b.words.take(pa.array(first)))], ["doc_id", "tfidf_keywords"])

    lines = lines or collection(line_table, entries_per_task)
    found = in_documents(lines.whole, best, "tfidf_keywords array<string>", stop_words)
    if lines.large is None:
        return found
    rows = line_profiles(lines.large)
    gathered = _ranked_terms(rows, top_n, stop_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return found.unionByName(rows.select("doc_id").distinct().join(gathered, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("r.term"), F.array().cast("array<string>")).alias("tfidf_keywords")))


def tfidf_keywords(line_table: DataFrame, top_n: int = 10, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Terms with the largest summed weight, rank 1 first; ties in alphabetical order."""
    return keyword_lists(line_table, top_n, stop_words).select("doc_id", F.posexplode("tfidf_keywords").alias("rank", "term")) \
        .withColumn("rank", F.col("rank") + 1)


def _common_factor(frequencies: Column) -> Column:
    """Greatest common divisor of positive numbers, by Euclid's steps; a 1 among them, as in most lines, ends the matter."""
    def divisor(a: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(64))  # more than any two 32-bit numbers need
        pair = F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))
        return pair["a"]

    one = F.lit(1).cast("bigint")
    return F.when(F.array_min(frequencies) == 1, one).when(F.size(frequencies) == 1, F.get(frequencies, F.lit(0))).otherwise(
        F.aggregate(frequencies, F.lit(0).cast("bigint"), lambda g, f: divisor(f, g)))


def line_groups(lines: DataFrame) -> DataFrame:
    """Lines that behave alike towards all others, as one row: ``(doc_id, pos, copies, vec, lone, lost)``.

    ``vec`` holds the terms found in several lines, (df, term, w, tf) from rare to frequent. A term of one single line
    can never be shared: what it does is take mass, ``lost``, from the others. Only the direction of a line counts, so
    frequencies are taken without their common factor. Lines with the same ``vec`` terms and the same frequencies of
    single terms, ``lone``, are one row here, be it a template filled in a million ways or one word repeated ever more
    often. ``pos`` is the first of the lines. Takes ``weighted_lines``, or the rows of ``weighted_terms``.
    """
    if "terms" not in lines.columns:
        lines = lines.groupBy("doc_id", "pos").agg(
            F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("df", "term", "w", "tf"))).alias("terms"))
    split = lines.select(
        "doc_id", "pos", "copies", _common_factor(F.col("terms.tf")).alias("factor"),
        F.filter("terms", lambda t: t["df"] > 1).alias("vec"), F.filter("terms", lambda t: t["df"] == 1).alias("single"))
    canonical = split.select(
        "doc_id", "pos", "copies", "vec",
        F.transform("vec", lambda t: F.struct(t["term"].alias("term"), (t["tf"] / F.col("factor")).cast("bigint").alias("tf"))).alias("core"),
        F.sort_array(F.transform("single", lambda t: (t["tf"] / F.col("factor")).cast("bigint"))).alias("lone"),
        F.aggregate("single", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"]).alias("lost"))
    return canonical.groupBy("doc_id", "core", "lone").agg(
        F.min("pos").alias("pos"), F.sum("copies").alias("copies"), F.min_by(F.struct("vec", "lost"), "pos").alias("v")
    ).select("doc_id", "pos", "copies", "v.vec", "lone", "v.lost")


def _signatures(groups: DataFrame, threshold: float) -> DataFrame:
    """Add the prefix lengths that a pair above the threshold cannot avoid sharing.

    Terms run from rare to frequent. Vectors have length one, so what two lines share is bounded by the mass (squared
    weight) of the shared part in either line. ``p1``: the terms after it hold no more than threshold² of the mass, so
    a matching line shares one of the first ``p1``; 0 where the lost mass alone rules a match out. ``p2``: even
    together with the heaviest of the first ``p2`` terms the rest holds no more than that, so a matching line shares
    two of them. ``level`` is 2 where that second bound exists and makes few keys.
    """
    limit = threshold * threshold - EPSILON

    # one pass over the terms: p1, p2, mass so far, heaviest so far
    def step(acc: Column, t: Column) -> Column:
        mass = acc["mass"] + t["w"] * t["w"]
        top = F.greatest(acc["top"], t["w"] * t["w"])
        return F.struct(
            mass.alias("mass"), top.alias("top"),
            (acc["p1"] + F.when(1 - acc["mass"] > limit, 1).otherwise(0)).alias("p1"),
            (acc["p2"] + F.when(acc["open"], 1).otherwise(0)).alias("p2"),
            (acc["open"] & (top + 1 - mass > limit)).alias("open"),
        )

    start = F.struct(F.col("lost").alias("mass"), F.lit(0.0).alias("top"), F.lit(0).alias("p1"), F.lit(0).alias("p2"),
                     F.lit(True).alias("open"))

    def levels(s: Column) -> Column:
        two = ~s["open"] & (s["p2"] >= 2) & (s["p2"] * (s["p2"] - 1) / 2 <= 2 * F.size("vec") + 8)
        return F.struct(s["p1"].alias("p1"), s["p2"].alias("p2"), F.when(two, 2).otherwise(1).alias("level"))

    return groups.withColumn("_s", let(F.aggregate("vec", start, step), levels)).select("*", "_s.*").drop("_s")


def near_duplicate_pairs(groups: DataFrame, threshold: float = 0.95, rows_per_salt: int = PAIRED_ROWS_PER_SALT) -> DataFrame:
    """Pairs of line groups with cosine above the threshold: ``(doc_id, a, b, line_pairs, cosine)``.

    Exact. Lines meet only on the rare terms that a matching pair must share: on pairs of them where both lines allow
    it, on single ones otherwise. Where they meet, the masses from that term on bound the cosine, and only pairs whose
    best meeting leaves them a chance fetch their vectors. A key that many lines of a document hold is split: its rows
    are dealt out on one side and copied on the other.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    signed = _signatures(groups, threshold)
    single = F.transform(F.slice("placed", F.lit(1), F.col("p1")), lambda t: F.struct(t["term"].alias("key"), t["tail"].alias("tail")))
    double = let(F.slice("placed", F.lit(1), F.col("p2")), lambda ts: F.flatten(F.transform(ts, lambda x, i: F.transform(
        F.slice(ts, i + 2, F.size(ts)), lambda y: F.struct(F.concat_ws(" ", x["term"], y["term"]).alias("key"), x["tail"].alias("tail"))))))
    # a key made of two terms holds a space, so the two kinds cannot meet
    keys = F.when(F.col("level") == 2, F.concat(single, double)).otherwise(single)
    # what a line has from a term on: nothing before the first shared term adds to the cosine
    leading = let(F.slice("vec", F.lit(1), F.greatest("p1", "p2")), lambda ts: F.transform(ts, lambda t, i: F.struct(
        t["term"].alias("term"), F.aggregate(F.slice(ts, F.lit(1), i), 1 - F.col("lost"), lambda left, x: left - x["w"] * x["w"]).alias("tail"))))
    keyed = signed.withColumn("placed", leading) \
        .select("doc_id", "pos", "level", F.explode(keys).alias("k")).select("doc_id", "pos", "level", "k.key", "k.tail")
    on = ["doc_id", "key"]
    largest = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hot = None
    if largest > rows_per_salt:  # no key is hotter than its document
        keyed = materialise(keyed)
        hot = skew.hot_keys(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, "n", rows_per_salt)
    own, others = keyed.where((F.col("level") == 1) | F.contains("key", F.lit(" "))), keyed
    if hot is not None:
        own, others = skew.add_salt(own, on, hot, ["pos"]), skew.replicate(others, on, hot)
        on = [*on, "_salt"]
    bound = F.sqrt(F.col("l.tail") * F.col("r.tail"))
    candidates = (
        own.alias("l").join(others.alias("r"), on)
        .where((F.col("l.pos") < F.col("r.pos")) | ((F.col("l.level") == 1) & (F.col("r.level") == 2)))
        .groupBy("doc_id", F.least("l.pos", "r.pos").alias("a"), F.greatest("l.pos", "r.pos").alias("b"))
        .agg(F.max(bound).alias("bound")).where(F.col("bound") > threshold - EPSILON).drop("bound")
    )
    left = groups.select("doc_id", F.col("pos").alias("a"), F.col("copies").alias("ca"), F.col("vec").alias("va"))
    right = groups.select("doc_id", F.col("pos").alias("b"), F.col("copies").alias("cb"), F.col("vec").alias("vb"))
    cosine = let(F.map_from_arrays(F.col("vb.term"), F.col("vb.w")), lambda w: F.aggregate(
        "va", F.lit(0.0), lambda acc, t: acc + t["w"] * F.coalesce(w[t["term"]], F.lit(0.0))))
    return (
        candidates.join(left, ["doc_id", "a"]).join(right, ["doc_id", "b"])
        .select("doc_id", "a", "b", (F.col("ca") * F.col("cb")).alias("line_pairs"), cosine.alias("cosine"))
        .where(F.col("cosine") > threshold)
    )


def _alike_in_batch(b: Batch, threshold: float) -> np.ndarray:
    """Pairs of lines above the threshold, of every document: the groups of ``line_groups``, each compared with all others
    of its document."""
    line, term, tf, w = b.weighted()
    shared = b.df[term] > 1
    found, cuts = np.zeros(b.n_docs), np.searchsorted(line, np.arange(len(b.pos) + 1))
    lost = np.bincount(line[~shared], w[~shared] ** 2, len(b.pos))
    held = np.flatnonzero(np.diff(cuts))
    factor = np.ones(len(b.pos), np.int64)
    factor[held] = np.gcd.reduceat(tf, cuts[held]) if len(held) else 1
    # rare terms come first, so the terms of a single line stand before the shared ones
    tf, split = tf // factor[line], cuts[:-1] + np.bincount(line[~shared], minlength=len(b.pos)).astype(np.int64)
    groups: dict[tuple, int] = {}
    copies: list[int] = []
    heads: list[int] = []
    for i in held.tolist():
        a, m, e = cuts[i], split[i], cuts[i + 1]
        at = groups.setdefault((b.doc_of_line[i], term[m:e].tobytes(), tf[m:e].tobytes(), np.sort(tf[a:m]).tobytes()), len(heads))
        if at == len(heads):
            heads.append(i)
            copies.append(0)
        copies[at] += int(b.copies[i])
    head, n = np.array(heads, np.int64), np.array(copies, np.float64)
    doc = b.doc_of_line[head]
    alike = (split[head] == cuts[head]) | (1 - lost[head] > threshold)
    found += np.bincount(doc[alike], n[alike] * (n[alike] - 1) / 2, b.n_docs)
    # what a line keeps of its mass bounds its cosine with any other
    near = np.flatnonzero((1 - lost[head] > threshold * threshold - EPSILON) & (split[head] < cuts[head + 1]))
    for d, part in zip(*_runs(doc[near], near), strict=True):
        if len(part) > 1:
            found[d] += _pairs_above(part, head, n, split, cuts, term, w, threshold)
    return found


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    at = np.flatnonzero(np.diff(keys)) + 1
    return (keys[np.concatenate([[0], at])].tolist(), np.split(values, at)) if len(keys) else ([], [])


def _pairs_above(part: np.ndarray, head: np.ndarray, n: np.ndarray, split: np.ndarray, cuts: np.ndarray, term: np.ndarray, w: np.ndarray,
                 threshold: float) -> float:
    """Line pairs of different groups of one document with a cosine above the threshold, some groups against all at a time."""
    first, last = split[head[part]], cuts[head[part] + 1]
    size = last - first
    start = np.cumsum(size) - size
    entry = np.repeat(first - start, size) + np.arange(size.sum())
    _, column = np.unique(term[entry], return_inverse=True)
    weight, width, total = w[entry], int(column.max()) + 1, 0.0
    step = max(1, PRODUCTS_AT_ONCE // max(len(entry), width))
    owner = np.repeat(np.arange(len(part)), size)
    for at in range(0, len(part), step):
        end = min(at + step, len(part))
        mine = slice(start[at], start[end] if end < len(part) else len(entry))
        block = np.zeros((width, end - at))
        block[column[mine], owner[mine] - at] = weight[mine]
        rest = slice(start[at], None)  # only groups from this block on
        cosine = np.add.reduceat(block[column[rest]] * weight[rest, None], start[at:] - start[at], axis=0)
        above = (cosine > threshold) & (np.arange(at, len(part))[:, None] > np.arange(at, end)[None, :])
        total += float((above * n[part[at:], None] * n[part[at:end]][None, :]).sum())
    return total


def repetition_rate(line_table: DataFrame, threshold: float = 0.95, lines: Collection | None = None,
                    entries_per_task: int = ENTRIES_PER_TASK, products_per_task: int = PRODUCTS_PER_TASK) -> DataFrame:
    """Share of line pairs whose cosine is above the threshold; 0 for fewer than two lines.

    Lines of one group are counted as n(n-1)/2 without making the pairs: copies match, and lines that differ in single
    terms all have the cosine 1 - lost, and so have lines that repeat the same terms in proportion. A line without terms
    matches nothing. Groups are compared inside the task that holds the document, or, in a larger one, where they meet.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")

    def rates(b: Batch) -> pa.RecordBatch:
        pairs = b.n_lines * (b.n_lines - 1) / 2
        return pa.RecordBatch.from_arrays([b.ids, pa.array(np.where(pairs > 0, _alike_in_batch(b, threshold) / np.maximum(pairs, 1), 0.0))],
                                          ["doc_id", "repetition_rate"])

    tables = []
    if lines is None:
        lines = collection(line_table, entries_per_task, products_per_task=products_per_task)
        whole = lines.whole
    else:  # gathered for others too, who take more
        entries = F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["terms"]))
        many = entries * F.size("lines") > products_per_task
        whole = lines.whole.where(~many)
        wide = materialise(lines.whole.where(many).select("doc_id", F.inline("lines")))
        tables += [] if wide.isEmpty() else [wide]
    if lines.large is not None:
        tables.append(line_profiles(lines.large).select("doc_id", F.col("pos").cast("bigint"), "copies", "terms"))
    found = in_documents(whole, rates, "repetition_rate double")
    for profiles in tables:
        found = found.unionByName(_repetition_of_tables(profiles, threshold))
    return found


def _repetition_of_tables(profiles: DataFrame, threshold: float) -> DataFrame:
    groups = materialise(line_groups(weighted_lines(profiles)))
    alike = (F.size("lone") == 0) | (1 - F.col("lost") > threshold)
    same = groups.where(alike).groupBy("doc_id").agg(F.sum(F.col("copies") * (F.col("copies") - 1) / 2).alias("same"))
    other = near_duplicate_pairs(groups, threshold).groupBy("doc_id").agg(F.sum("line_pairs").alias("other"))
    sizes = profiles.groupBy("doc_id").agg(F.sum("copies").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    found = F.coalesce("same", F.lit(0.0)) + F.coalesce("other", F.lit(0))
    return sizes.join(same, "doc_id", "left").join(other, "doc_id", "left").select(
        "doc_id", F.when(pairs > 0, found / pairs).otherwise(0.0).alias("repetition_rate"))
