"""Mixing sources by temperature.

A source with the share s of all tokens gets a weight in proportion to s to the power of an exponent between 0 (all
equal) and 1 (as they are). Bisection finds the largest exponent whose weights reach a target entropy, or the smallest
that repeats no source more often than allowed. The weights are then realised: a source's documents are dealt into
blocks, each epoch is a keyed permutation of the blocks, and epochs follow each other until the source's token budget is
used up. So every document of a source appears equally often, give or take one, and a source that keeps its share keeps all
its documents. The last epoch ends at the document that brings its sum nearest to what is left of the budget.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.operators.ordering import with_running_total
from cuesheet.session import materialise

HALVINGS_PER_PASS, PASSES = 5, 8  # one pass over the sources tries 31 exponents, which is five halvings
DIGITS = 9
BLOCK_DOCUMENTS = 1024


@dataclass(frozen=True)
class Target:
    """What the exponent must meet. Entropy is a share of the largest possible one; the budget is a share of all tokens."""

    entropy: float | None = 0.95
    repetitions: float | None = None
    budget: float = 1.0


def source_name(column: str = "source") -> Column:
    """A null source counts as the source without a name."""
    return F.coalesce(F.col(column), F.lit(""))


def token_count(column: str = "text") -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def digest(key: str, *parts: Column) -> Column:
    joined = [F.lit(f"{key}")]
    for p in parts:
        joined += [F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))]
    return F.md5(F.concat(*joined))


def find_exponent(sources: DataFrame, target: Target) -> float:
    """Bisect over ``(tokens)`` of sources that have any.

    Each pass evaluates the 31 inner points of five halvings at once, as sums over the source table, which may be large.
    Entropy falls and repetition of the smallest source falls as the exponent grows. The result is rounded.
    """
    if (target.entropy is None) == (target.repetitions is None):
        raise ValueError("give either a target entropy or a limit of repetitions")
    totals = sources.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    if totals["n"] < 2:
        return 1.0
    total, share = totals["tokens"], F.col("tokens") / F.lit(totals["tokens"])
    low, high = 0.0, 1.0
    points = 1 << HALVINGS_PER_PASS
    for step in range(PASSES + 1):
        tries = [0.0, 1.0] if step == 0 else [low + (high - low) * i / points for i in range(1, points)]
        sums = []
        for i, a in enumerate(tries):
            w = F.pow(share, F.lit(a))
            sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"e{i}"), F.max(w / F.col("tokens")).alias(f"r{i}")]
        row = sources.agg(*sums).first()

        def fits(i: int, row=row) -> bool:
            if target.entropy is not None:
                return log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] >= target.entropy * log(totals["n"]) - 1e-12
            return target.budget * total * row[f"r{i}"] / row[f"z{i}"] <= target.repetitions + 1e-12

        good = [fits(i) for i in range(len(tries))]
        if target.entropy is not None:  # true up to the exponent that is sought
            if step == 0 and (good[1] or not good[0]):
                return 1.0 if good[1] else 0.0
            if step:
                n = next((i for i, g in enumerate(good) if not g), len(good))
                low, high = (tries[n - 1] if n else low), (tries[n] if n < len(tries) else high)
        else:  # true from it on
            if step == 0 and (good[0] or not good[1]):
                return 0.0 if good[0] else 1.0
            if step:
                n = next((i for i, g in enumerate(good) if g), len(good))
                low, high = (tries[n - 1] if n else low), (tries[n] if n < len(tries) else high)
    return round(low if target.entropy is not None else high, DIGITS)


def source_budgets(slim: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """``(name, documents, tokens, weight, budget, passes, rest, blocks)`` per source, and the exponent.

    ``passes`` is how often the whole source is taken, ``rest`` the tokens of the last, partial epoch. A source without
    tokens costs nothing and is taken once.
    """
    sources = materialise(slim.groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")))
    filled = sources.where(F.col("tokens") > 0)
    exponent = find_exponent(filled, target)
    total = filled.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(exponent))).otherwise(0.0)
    norm = filled.agg(F.coalesce(F.sum(F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(exponent))), F.lit(1.0))).first()[0]
    share = raw / F.lit(norm)
    budgeted = sources.withColumn("weight", F.round(share, DIGITS)) \
        .withColumn("budget", F.floor(share * F.lit(float(target.budget * total)) + 0.5).cast("bigint"))
    return budgeted.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("bigint")) \
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0).cast("bigint")) \
        .withColumn("blocks", F.ceil(F.col("documents") / BLOCK_DOCUMENTS).cast("bigint")), exponent


def plan(docs: DataFrame, target: Target = Target(), key: str = "mix") -> DataFrame:
    """``(doc_id, source, tokens, weight, block, passes, copies)`` for every row of ``documents``, with 0 copies for rows left out.

    The order of a source's last epoch is that of its blocks by a digest of key, source, epoch and block, and inside a
    block that of a digest of key and doc_id. Whole blocks are counted first; only the one block where the budget ends
    is counted by documents. Running totals are taken over ranges of that order, so no source is sorted in one task. A
    document of more than twice what is left of the budget cannot be in the last epoch and does not end it; the document
    at the border is taken if the sum is nearer to the budget with it.
    Null texts count as empty, a null source as the source without a name; repeated rows are rows of their own, one of
    them may be taken and the other not. No rows give no rows. Columns other than doc_id, text and source are ignored.
    """
    slim = materialise(docs.select(
        "doc_id", "source", source_name().alias("name"), token_count().alias("tokens"), digest(key, F.col("doc_id")).alias("place"),
        F.monotonically_increasing_id().alias("_row")))
    sources, _ = source_budgets(slim, target)
    sources = materialise(sources)
    joined = skew.lookup(slim, sources.select("name", "weight", "passes", "rest", "blocks"), ["name"], ["_row"])
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint")
    dealt = materialise(joined.withColumn("block", F.pmod(number, F.col("blocks"))).withColumn("fits", F.col("tokens") <= 2 * F.col("rest")))
    totals = dealt.groupBy("name", "block").agg(
        F.sum(F.when(F.col("fits"), F.col("tokens")).otherwise(0)).alias("block_tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    ordered = totals.withColumn("turn", digest(key, F.col("name"), F.col("passes"), F.col("block")))
    upto = materialise(with_running_total(ordered, ["name"], [F.col("turn"), F.col("block")], F.col("block_tokens"), "upto"))
    state = upto.select("name", "block", F.when(F.col("upto") <= F.col("rest"), F.lit(1)).when(
        F.col("upto") - F.col("block_tokens") < F.col("rest"), F.lit(2)).otherwise(0).alias("state"),
        (F.col("rest") - (F.col("upto") - F.col("block_tokens"))).alias("left"))
    placed = dealt.join(state.hint("merge"), ["name", "block"])
    border = placed.where((F.col("state") == 2) & F.col("fits"))
    inside = with_running_total(border, ["name"], [F.col("place"), F.col("doc_id"), F.col("tokens"), F.col("_row")], F.col("tokens"), "_upto")
    before, over = F.col("_upto") - F.col("tokens"), F.col("_upto") - F.col("left")
    taken = inside.withColumn("more", ((over <= 0) | ((before < F.col("left")) & (over < F.col("left") - before))).cast("bigint")).drop("_upto")
    others = placed.where((F.col("state") != 2) | ~F.col("fits")).withColumn("more", F.when(F.col("fits"), F.col("state") % 2).otherwise(0).cast("bigint"))
    every = others.unionByName(taken)
    more = F.when(F.col("rest") > 0, F.col("more")).otherwise(0)
    return every.select("doc_id", "source", "tokens", "weight", "block", "passes", (F.col("passes") + more).alias("copies"), "_row")


def mixed_plan(docs: DataFrame, target: Target = Target(), key: str = "mix") -> DataFrame:
    return plan(docs, target, key).drop("_row")


def mixed(docs: DataFrame, target: Target = Target(), key: str = "mix") -> DataFrame:
    """The rows of ``documents`` as often as the plan says, with all their columns; a row of 0 copies is gone.

    Rows of equal doc_id and source are told apart by their tokens only; where they are alike in all three, each is
    taken as often as the one taken most. Columns of any name pass through.
    """
    counts = plan(docs, target, key).groupBy(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("name"), "tokens") \
        .agg(F.max("copies").cast("int").alias("copies")).where(F.col("copies") > 0)
    # the row goes as one struct, so that no name of its columns meets a name of the plan
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), source_name().alias("own_name"), token_count().alias("own_tokens"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_name") == F.col("name")) & (F.col("own_tokens") == F.col("tokens"))
    met = rows.join(counts.hint("merge"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return met.select("row.*")


def plan_sql(documents: str = "documents", target: Target = Target(), key: str = "mix") -> str:
    """The same in DuckDB, for an entropy target and distinct doc_ids; bisection is a recursive table."""
    def sha(*parts: str) -> str:
        return "md5('" + key + "' || " + " || ".join(f"':' || coalesce(({p})::VARCHAR, '')" for p in parts) + ")"

    halvings = HALVINGS_PER_PASS * PASSES
    w = "pow(tokens / total, {a})"
    entropy = f"(SELECT ln(sum({w})) - sum({w} * ln({w})) / sum({w}) FROM filled)"
    goal = f"{target.entropy} * ln((SELECT count(*) FROM filled)) - 1e-12"
    return f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS tokens, {sha('doc_id')} AS place
  FROM {documents}),
sources AS (SELECT name, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM slim GROUP BY name),
filled AS (SELECT tokens::DOUBLE AS tokens, (SELECT sum(tokens) FROM sources)::DOUBLE AS total FROM sources WHERE tokens > 0),
halved AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN middle ELSE low END, CASE WHEN good THEN high ELSE middle END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
               {entropy.format(a="((low + high) / 2)")} >= {goal} AS good
        FROM halved WHERE step < {halvings})),
exponent AS (
  SELECT CASE WHEN (SELECT count(*) FROM filled) < 2 OR {entropy.format(a="1.0")} >= {goal} THEN 1.0
              WHEN {entropy.format(a="0.0")} < {goal} THEN 0.0
              ELSE round((SELECT low FROM halved WHERE step = {halvings}), {DIGITS}) END::DOUBLE AS a),
raw AS (SELECT s.*, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT max(total) FROM filled), (SELECT a FROM exponent)) ELSE 0 END AS w FROM sources s),
weighted AS (SELECT name, documents, tokens, w / (SELECT sum(w) FROM raw) AS share FROM raw),
budgeted AS (SELECT *, round(share, {DIGITS}) AS weight, floor(share * (SELECT max(total) FROM filled) * {float(target.budget)} + 0.5)::BIGINT AS budget FROM weighted),
budgets AS (
  SELECT name, weight, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END::BIGINT AS passes,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest, ceil(documents / {BLOCK_DOCUMENTS})::BIGINT AS blocks FROM budgeted),
dealt AS (SELECT slim.*, weight, passes, rest, ('0x' || substr(place, 1, 8))::BIGINT % blocks AS block FROM slim JOIN budgets USING (name)),
ranked AS (SELECT *, sum(CASE WHEN tokens <= 2 * rest THEN tokens ELSE 0 END) OVER (
             PARTITION BY name ORDER BY {sha('name', 'passes', 'block')}, block, place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, source, tokens, weight, block, passes,
       (passes + CASE WHEN rest > 0 AND tokens <= 2 * rest AND (upto <= rest OR (upto - tokens < rest AND upto - rest < rest - (upto - tokens)))
                      THEN 1 ELSE 0 END)::BIGINT AS copies
FROM ranked"""
