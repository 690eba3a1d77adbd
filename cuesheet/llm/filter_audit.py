"""How filters of documents interact: what each order of them keeps, removes, and removes twice.

Every filter leaves a relation of the ids that fail it, stored once. All orders of the filters share the same few prefix
sets, so one chain of left-anti joins, one per filter, serves every prefix: before the join with a filter's relation each
row stands once without the filter in its prefix and once with it, and only the latter may be removed. What is left of a
filter's own relation under a prefix is what the filter removes there; what is left of the ids that fail anything are
survivors. Left-semi joins with the ids of good and of toxic labels give the label losses in the same chain.

The id relations are partitioned and sorted by id, so no join of the chain moves a row; only counts are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200
SIGNS = r"[#$%&*|]"
COPY = "E"


def content() -> Column:
    return F.coalesce("text", F.lit(""))


def text_filters() -> dict[str, Column]:
    """Failure conditions that a text decides by itself."""
    words = F.regexp_extract_all(content(), F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(content(), "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals.cast("bigint") * 100 > F.length(content()).cast("bigint") * 2,
        "D": content().rlike(SIGNS),
    }


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_row(df: DataFrame) -> DataFrame:
    """Stored with one hash partitioning, in which every relation meets every other one without a shuffle."""
    return materialise(df.repartition(partitions(df.sparkSession), "row").sortWithinPartitions("row"))


def copies_of_smaller(slim: DataFrame) -> DataFrame:
    """Rows whose text a smaller doc_id has too. A missing doc_id is neither smaller nor larger than any other."""
    groups = materialise(slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    met = skew.salted_lookup(slim, groups.select("digest", "first"), ["digest"], groups.select("digest", "n"), "n", ["row"])
    return met.where(F.col("doc_id") > F.col("first")).select("row", "part")


def failing_relations(docs: DataFrame, part: Column, filters: Mapping[str, Column], copies: str | None = COPY) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(row, doc_id, part)`` of every row and one stored ``(row, part)`` table per filter with the rows that fail it.

    ``filters`` are conditions on a row of ``docs``, a null condition does not fail; ``copies`` names the filter of texts
    that a smaller doc_id has too.
    """
    flags = F.array(*[F.when(c, F.lit(name)) for name, c in filters.items()])
    slim = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", part.alias("part"),
                                   F.sha2(content().cast("binary"), 256).alias("digest"), F.array_compact(flags).alias("fails")))
    tables = {name: slim.where(F.array_contains("fails", name)).select("row", "part") for name in filters}
    if copies:
        tables[copies] = copies_of_smaller(slim.select("row", "doc_id", "part", "digest"))
    return slim.select("row", "doc_id", "part"), {name: by_row(table) for name, table in sorted(tables.items())}


def labelled(rows: DataFrame, labels: DataFrame, condition: Column) -> DataFrame:
    """Rows whose doc_id has a label that meets the condition."""
    return by_row(rows.join(labels.where(condition).select("doc_id").hint("merge"), "doc_id", "left_semi").select("row"))


def prefix_counts(failing: Mapping[str, DataFrame], marks: Mapping[str, DataFrame]) -> DataFrame:
    """``(part, filter, mark, prefix, n)``: rows that fail ``filter`` and none of the filters whose bits ``prefix`` holds.

    The filter '' stands for all rows that fail anything. The mark '' counts every row, the others those in the relation of
    that name.
    """
    bits = {name: 1 << i for i, name in enumerate(failing)}
    own = [(name, mark, table if relation is None else table.join(relation.hint("merge"), "row", "left_semi"))
           for name, table in failing.items() for mark, relation in [("", None), *marks.items()]]
    anything = reduce(DataFrame.unionByName, failing.values()).distinct()
    chain = reduce(DataFrame.unionByName, [t.withColumns({"filter": F.lit(name), "mark": F.lit(mark)}) for name, mark, t in [*own, ("", "", anything)]])
    chain = chain.repartition(partitions(chain.sparkSession), "row").withColumn("prefix", F.lit(0))
    for name, table in failing.items():
        applied = F.when(F.col("filter") == name, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        both = chain.withColumn("applied", F.explode(applied))
        gone = table.select(F.col("row").alias("gone")).hint("merge")
        chain = both.join(gone, (F.col("row") == F.col("gone")) & F.col("applied"), "left_anti") \
            .withColumn("prefix", F.col("prefix") + F.when(F.col("applied"), bits[name]).otherwise(0)).drop("applied")
    return materialise(chain.groupBy("part", "filter", "mark", "prefix").agg(F.count(F.lit(1)).alias("n")))


def steps_of(names: list[str]) -> Column:
    """A literal: every order of the filters, step by step, with the prefix before it and after it."""
    bits = {name: 1 << i for i, name in enumerate(names)}
    rows = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            rows.append({"filter_order": "".join(order), "step": step, "filter": name, "before": before, "after": before | bits[name]})
            before |= bits[name]
    return F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,filter:string,before:int,after:int>>"))


def audit(rows: DataFrame, failing: Mapping[str, DataFrame], marks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per part, order and step with ``kept, removed, redundant, unique_fails, shapley`` and ``<mark>_lost`` per mark."""
    names, everything = list(failing), (1 << len(failing)) - 1
    counts = prefix_counts(failing, marks)
    keys = ["part", "filter", "prefix"]
    removed = counts.where(F.col("filter") != "").groupBy(*keys).agg(
        F.sum(F.when(F.col("mark") == "", F.col("n"))).alias("removed"),
        *[F.sum(F.when(F.col("mark") == m, F.col("n"))).alias(f"{m}_lost") for m in marks])
    survivors = counts.where(F.col("filter") == "").select("part", "prefix", F.col("n").alias("survivors"))
    touched = survivors.where(F.col("prefix") == 0).select("part", F.col("survivors").alias("touched"))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).join(touched, "part", "left")
    failed = removed.where(F.col("prefix") == 0).select("part", "filter", F.col("removed").alias("failed"))
    others = reduce(lambda c, i: c.when(F.col("filter") == names[i], everything - (1 << i)), range(len(names)), F)
    alone = removed.where(F.col("prefix") == others).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = parts.select("*", steps_of(names).alias("s")).select("part", "total", "touched", "s.*")
    met = steps.join(removed.withColumnRenamed("prefix", "before"), ["part", "filter", "before"], "left") \
        .join(survivors.withColumnRenamed("prefix", "after"), ["part", "after"], "left") \
        .join(failed, ["part", "filter"], "left").join(alone, ["part", "filter"], "left") \
        .fillna(0, ["touched", "removed", "survivors", "failed", "unique_fails", *[f"{m}_lost" for m in marks]])
    added = met.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return met.join(added, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - F.col("touched") + F.col("survivors")).alias("kept"), "removed",
        (F.col("failed") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over ``documents`` per source, with losses of good and of toxic labels.

    A: under 200 words; B: fewer distinct words than half of them; C: more than 2 % capitals A-Z; D: a sign of ``#$%&*|``;
    E: a smaller doc_id has the same text. A null text counts as empty, a null source as the empty one. Repeated rows are
    rows of their own. A label counts where any row of ``labels`` for the doc_id has it. No rows give no rows; columns other
    than doc_id, text and source are ignored. A source or a text that many rows have is counted per task first, or salted.
    """
    slim = docs.select("doc_id", "text", "source")
    rows, failing = failing_relations(slim, F.coalesce("source", F.lit("")), text_filters())
    marks = {"good": labelled(rows, labels, F.col("quality") == 1), "toxic": labelled(rows, labels, F.col("toxic") == 1)}
    return audit(rows, failing, marks)


def audit_sql(documents: str = "documents", labels: str = "labels") -> str:
    """The same in DuckDB, from the set of filters each document fails."""
    names = "ABCDE"
    columns = [f"o{i}" for i in range(5)]
    letters = ", ".join(f"('{n}', {1 << i})" for i, n in enumerate(names))
    joins = " ".join(f"JOIN letters {c} ON " + (" AND ".join(f"{c}.l <> {d}.l" for d in columns[:i]) or "true") for i, c in enumerate(columns) if i)
    order = " || ".join(f"{c}.l" for c in columns)
    steps = " UNION ALL ".join(
        f"SELECT {order} AS filter_order, {i + 1} AS step, {columns[i]}.b AS bit, "
        f"{' + '.join(f'{c}.b' for c in columns[:i]) or '0'} AS before FROM letters o0 {joins}" for i in range(5))
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
flagged AS (
  SELECT part, doc_id,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails,
         doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM {labels} WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM words),
sets AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY part, fails),
letters(l, b) AS (VALUES {letters}),
steps AS ({steps}),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets JOIN steps ON true GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted"""
