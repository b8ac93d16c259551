"""Temperature mixing of sources to target weights (native).

Source token shares ``p`` become weights ``p^a / sum(p^a)``.  The exponent ``a``
in 0..1 is bisected: the largest one that reaches the target entropy, raised
where needed so that no source is repeated more often than the limit.  Weights
times the budget are the sources' quotas, in tokens.  A source's stream is one
permutation of its documents (a *block*: by the md5 of seed, epoch and id) after
another until its quota is met: whole epochs, then the part of one.  The mixed
stream is dealt out in blocks of ``block_tokens``, each with every source at its
weight, and shuffled inside.

Tokens are runs of other than white space.  A null or empty text has no tokens;
such a document goes wherever its place in the permutation is reached; a source
without any token has no share, no weight and no rows in the mix.  A null source is
the source ``''.  Rows with equal ids are told apart by their
token counts, and else are interchangeable.  An empty table, or one without any
token, gives no rows.  Extra columns are ignored.  Documents beyond their
source's quota are not in the result: that is the mixing.

Scale: texts are read once, to counts of tokens.  Quotas come from sums in
slices of the permutation (by the first digits of the md5: as many as keep a
slice at ``SLICE`` documents, up to 65,536 slices a source), so that a source
with most of the rows is as many slices, not one task.  The exponent depends on the
sources' token counts alone, so what the bisection reads are the different
counts and how many sources have each (fewer than the root of twice the tokens).
Up to ``SHARES`` of them are gathered in one row; beyond that none are, and each
step takes its sums from all tasks.  Both ways read every count, and their sums are
exact ones of decimals, the same in any order: so both give the same exponent.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, table

#: Up to so many different token counts of sources are gathered in one row.
SHARES = 100_000
EXACT = "decimal(37,18)"
ENTROPY, REPEATS, BLOCK_TOKENS, SEED, STEPS, SLICE = 0.98, 4.0, 100_000, 17, 50, 250
#: Up to so many sources their quotas are broadcast; beyond, they are joined in a shuffle, where AQE splits a large source.
BROADCAST_SOURCES = 10_000


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` of every row."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n.alias("tokens"))


def entropy_of(z: Column, logs: Column, a: Column) -> Column:
    return F.log(z) - a * logs / z


def repeats_of(z: Column, low: Column, a: Column) -> Column:
    """Quota over own tokens, at its most for the source of the smallest share, ``low``."""
    return F.pow(low, a) / z / low * F.col("asked") / F.col("total")


def exponent_in_row(sizes: DataFrame, entropy: float, repeats: float, budget: int | None) -> DataFrame:
    """``exponent, total, asked, z`` (the sum of the powers) of ``t, n``: the different token counts and how many sources have each."""
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("rows"), F.sum(F.col("t") * F.col("n")).alias("total"), F.sum("n").alias("sources"))
    one = one.filter("total > 0").select(
        "rows", "sources", "total", F.lit(budget).cast("double").alias("asked") if budget else F.col("total").alias("asked"),
        F.transform("rows", lambda r: F.struct((r["t"] / F.col("total")).alias("x"), r["n"].alias("n"))).alias("p"),
    )

    def total_of(term: Callable[[Column], Column]) -> Column:
        add = lambda acc, s: (acc + (s["n"] * term(s["x"])).cast(EXACT)).cast(EXACT)
        return F.aggregate("p", F.lit(0).cast(EXACT), add).cast("double")

    def entropy_at(a: Column) -> Column:
        return entropy_of(total_of(lambda x: F.pow(x, a)), total_of(lambda x: F.pow(x, a) * F.log(x)), a)

    def repeats_at(a: Column) -> Column:
        return repeats_of(total_of(lambda x: F.pow(x, a)), F.get("p", 0)["x"], a)

    def bisect(keep_low: object) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            ok = keep_low(mid)
            return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    goal = F.lit(entropy) * F.log(F.col("sources").cast("double"))
    # entropy falls with the exponent, and so do the repeats of the rarest source
    flat = F.when(entropy_at(F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(bisect(lambda a: entropy_at(a) >= goal)["lo"])
    held = F.when(repeats_at(F.lit(0.0)) <= repeats, F.lit(0.0)).otherwise(bisect(lambda a: repeats_at(a) > repeats)["hi"])
    return one.withColumn("exponent", F.greatest(flat, held)).select("exponent", "total", "asked", total_of(lambda x: F.pow(x, F.col("exponent"))).alias("z"))


def exponent_in_steps(sizes: DataFrame, entropy: float, repeats: float, budget: int | None) -> DataFrame:
    """The same by the same bisections, a job a step for both; nothing is gathered but sums."""
    sizes = materialise(sizes, "sizes")
    whole = sizes.agg(F.sum(F.col("t") * F.col("n")).alias("total"), F.sum("n").alias("sources"), F.min("t").alias("t")).first()
    total, low = whole["total"], F.lit(whole["t"] / whole["total"])
    known = {"total": F.lit(total), "asked": F.lit(float(budget or total))}
    x, goal = F.col("t") / F.lit(total), F.lit(entropy) * F.log(F.lit(float(whole["sources"])))

    def at(flat: float, held: float) -> tuple[bool, bool, float]:
        """Whether one exponent reaches the entropy and whether another repeats too often; the sum of the powers at the first."""
        terms = {"z": F.pow(x, F.lit(flat)), "logs": F.pow(x, F.lit(flat)) * F.log(x), "of_held": F.pow(x, F.lit(held))}
        sums = sizes.agg(*(F.sum((F.col("n") * term).cast(EXACT)).cast("double").alias(name) for name, term in terms.items())).withColumns(known)
        reached = entropy_of(F.col("z"), F.col("logs"), F.lit(flat)) >= goal
        return tuple(sums.select(reached, repeats_of(F.col("of_held"), low, F.lit(held)) > repeats, "z").first())

    all_flat, too_often, _ = at(1.0, 0.0)
    flat, held = [0.0, 1.0], [0.0, 1.0]
    for _ in range(STEPS):
        mid = [sum(flat) / 2, sum(held) / 2]
        reached, over, _ = at(*mid)
        flat[0 if reached else 1] = mid[0]
        held[0 if over else 1] = mid[1]
    exponent = max(1.0 if all_flat else flat[0], held[1] if too_often else 0.0)
    known |= {"z": F.lit(at(exponent, exponent)[2]), "exponent": F.lit(exponent)}
    discard(sizes)
    return sizes.sparkSession.range(1).select(*(value.alias(name) for name, value in known.items()))


def quotas(counts: DataFrame, entropy: float, repeats: float, budget: int | None) -> DataFrame:
    """``source, source_tokens, docs, exponent, quota, budget``.  ``entropy`` is a part of log(number of sources)."""
    by_source = counts.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("docs")).filter("t > 0")
    sizes = by_source.groupBy(F.col("t").cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    chosen = (exponent_in_row if sizes.count() <= SHARES else exponent_in_steps)(sizes, entropy, repeats, budget)
    return by_source.crossJoin(F.broadcast(chosen)).select(  # with its one row
        "source", F.col("t").alias("source_tokens"), "docs", "exponent",
        # in parts of the own tokens, to nine digits: an error in the last ones must not begin another epoch
        (F.round(F.pow(F.col("t") / F.col("total"), F.col("exponent")) / F.col("z") * F.col("asked") / F.col("t"), 9) * F.col("t")).alias("quota"),
        F.col("asked").alias("budget"),
    )


def mix(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, source, tokens, epoch, block, position`` of the mixed stream; the budget is all tokens unless given."""
    counts = materialise(token_counts(docs), "tokens")
    plan = materialise(quotas(counts, entropy, repeats, budget), "quotas")
    size = plan.agg(F.count(F.lit(1)).alias("n"), F.max("docs").alias("docs")).first()
    digits = max(1, min(4, math.ceil(math.log(max(1, (size["docs"] or 0) / SLICE), 16))))
    per_source = F.broadcast(plan) if size["n"] <= BROADCAST_SOURCES else plan
    epochs = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("quota") / F.col("source_tokens")) - 1, F.lit(0)).cast("long"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    drawn = (
        counts.join(per_source, "source")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("key", key)
        .withColumn("slice", F.substring("key", 1, digits))
    )
    by_slice = drawn.groupBy("source", "epoch", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.select("source", "epoch", "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("slice_start"))
    within = Window.partitionBy("source", "epoch", "slice").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("source_tokens") + F.col("slice_start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    blocks = F.ceil(F.col("budget") / block_tokens)
    placed = (
        drawn.join(starts, ["source", "epoch", "slice"])
        .withColumn("at", at)
        .filter(F.col("at") < F.col("quota"))
        .withColumn("block", F.floor(F.col("at") / F.col("quota") * blocks).cast("long"))
    )
    order = Window.partitionBy("block").orderBy("key", "doc_id", "source", "tokens")
    return placed.select("doc_id", "source", "tokens", "epoch", "block", F.row_number().over(order).cast("long").alias("position"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents") -> str:
    power_sum = lambda a: f"list_sum(list_transform(p, lambda x: pow(x, {a})))"
    entropy = lambda a: f"(ln({power_sum(a)}) - {a} * list_sum(list_transform(p, lambda x: pow(x, {a}) * ln(x))) / {power_sum(a)})"
    repeats = lambda a: f"(pow(list_min(p), {a}) / {power_sum(a)} / list_min(p))"
    mid, goal = "((lo + hi) / 2)", f"{ENTROPY} * ln(len(p))"
    return f"""
WITH RECURSIVE counts AS (
  SELECT doc_id, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM {documents}
), per_source AS (
  SELECT source, sum(tokens)::BIGINT AS t FROM counts GROUP BY source HAVING sum(tokens) > 0
), one AS (
  SELECT list(t::DOUBLE / total ORDER BY source) AS p, any_value(total) AS total
  FROM per_source, (SELECT sum(t)::DOUBLE AS total FROM per_source)
), flat AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, p FROM one
  UNION ALL SELECT i + 1, CASE WHEN {entropy(mid)} >= {goal} THEN {mid} ELSE lo END,
    CASE WHEN {entropy(mid)} >= {goal} THEN hi ELSE {mid} END, p FROM flat WHERE i < {STEPS}
), held AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, p FROM one
  UNION ALL SELECT i + 1, CASE WHEN {repeats(mid)} > {REPEATS} THEN {mid} ELSE lo END,
    CASE WHEN {repeats(mid)} > {REPEATS} THEN hi ELSE {mid} END, p FROM held WHERE i < {STEPS}
), chosen AS (
  SELECT greatest(CASE WHEN {entropy('1.0')} >= {goal} THEN 1.0 ELSE (SELECT lo FROM flat WHERE i = {STEPS}) END,
    CASE WHEN {repeats('0.0')} <= {REPEATS} THEN 0.0 ELSE (SELECT hi FROM held WHERE i = {STEPS}) END) AS a, p, total FROM one
), plan AS (
  SELECT source, t, round(pow(t / total, a) / {power_sum('a')} * total / t, 9) * t AS quota, total AS budget FROM per_source, chosen
), drawn AS (
  SELECT *, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM (SELECT counts.*, t, quota, budget, unnest(range(greatest(ceil(quota / t), 1)::BIGINT)) AS epoch FROM counts JOIN plan USING (source))
), placed AS (
  SELECT *, epoch * t + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn
), dealt AS (
  SELECT *, floor(start / quota * ceil(budget / {BLOCK_TOKENS}))::BIGINT AS block FROM placed WHERE start < quota
)
SELECT doc_id, source, tokens, epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY key, doc_id, source, tokens) AS position FROM dealt
"""


ORACLE_SQL = oracle()
