"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share times all documents over its own.  A document's
number of copies is the Poisson distribution of that mean, inverted at a uniform number that comes from hashing
seed and ``doc_id``: the same on every run, machine and layout.  Rows are exploded by their count and ordered
by another hash, globally: ``mix_key`` is the order.  As it is uniform, equal stretches of it are the partitions: no
sample of the rows is needed to find their bounds, so copies are drawn once.

Hot sources: rates need one count per source, combined before the shuffle; copies are made after a broadcast of
the rates if the number of sources is at most ``MAX_BROADCAST`` (counted), else after a join.

Nulls and edges: a null source is a source of its own; a null or repeated ``doc_id`` hashes like any value, so
equal rows get equal counts and, copy by copy, equal keys; sources without a target weight get none (rate 0);
weights are relative and negative ones are refused.  Long inversions: sums end at mean + 12 * sqrt(mean) + 30, and
for means over ``LARGE`` start as far below the mean, as exp(-mean) is 0 there: what is left out is far below u's step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20240117
ALPHA = 0.5
MAX_BROADCAST = 10_000
LARGE = 600


def unit(*parts):
    """A uniform number in (0, 1) from the md5 of the parts: 52 bits, half a step off 0."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("<null>")) if isinstance(p, str) else p for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(mean, u):
    """The smallest k with P(X <= k) >= u."""
    reach = 12 * F.sqrt(mean) + 30
    top = F.ceil(mean + reach).cast("int")
    low = F.when(mean > LARGE, F.floor(mean - reach)).otherwise(0).cast("int")
    # P(X = low), ln(low!) by Stirling's series
    log_p = low * F.log(mean / low) + (low - mean) - F.log(low * (2 * math.pi)) / 2 - 1 / (12.0 * low) + 1 / (360.0 * low * low * low)
    p_low = F.when(mean > LARGE, F.exp(log_p)).otherwise(F.exp(-mean))
    start = F.struct(p_low.alias("p"), p_low.alias("c"), low.alias("k"))

    def step(acc, i):
        p = acc["p"] * mean / i
        return F.when(acc["c"] >= u, acc).otherwise(F.struct(p.alias("p"), (acc["c"] + p).alias("c"), i.cast("int").alias("k")))

    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(low + 1, top), start, step, lambda a: a["k"]))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, rate); without weights a source's target share goes with its count to the power ``alpha``."""
    counts = docs.groupBy(F.col("source").alias("__source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        target = counts.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        target = counts.join(given, F.col("__source").eqNullSafe(F.col("s")), "left").select("__source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = target.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    return target.join(F.broadcast(total)).select("__source", F.when(F.col("tw") > 0, F.col("w") / F.col("tw") * F.col("tn") / F.col("n")).otherwise(0.0).alias("__rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """``docs`` with ``copy`` (from 0) and ``mix_key``, each row as often as drawn, in order of ``mix_key``."""
    rate = rates(docs, weights, alpha)
    if rate.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        rate = F.broadcast(rate)
    rows = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").alias("__id"), F.col("source").alias("__s"))
    joined = rows.join(rate, F.col("__s").eqNullSafe(F.col("__source")))
    drawn = joined.withColumn("__n", poisson(F.col("__rate"), unit(F.lit(str(seed)), "__id"))).where("__n > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    out = copies.withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("__id").cast("string"), F.lit("<null>")), F.col("__copy").cast("string"))))
    if shuffle:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") * parts / float(1 << 32)).cast("int")
        out = out.repartitionById(parts, place).sortWithinPartitions("__key", "__id", "__copy")
    taken = {c.lower() for c in docs.columns}

    def name(c: str) -> str:
        while c in taken:
            c += "_mix"
        return c

    return out.select("__doc.*", F.col("__copy").cast("long").alias(name("copy")), F.col("__key").alias(name("mix_key")))


query = mix

#: ``{docs}`` is a table or subquery with doc_id and source; ``{cols}`` its columns to return.
SQL = """
WITH docs AS (SELECT * FROM {docs}),
counts AS (SELECT source, count(*)::DOUBLE AS n FROM docs GROUP BY source),
rates AS (SELECT source, (n ** 0.5) / sum(n ** 0.5) OVER () * sum(n) OVER () / n AS rate FROM counts),
drawn AS (
  SELECT d.*, r.rate, (('0x' || substr(md5('20240117:' || coalesce(d.doc_id::VARCHAR, '<null>')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, (SELECT unnest(range(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 30)::BIGINT FROM rates))) AS k))),
copies AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u) AS n FROM drawn d)
SELECT {cols}, copy, md5('20240117:order:' || coalesce(doc_id::VARCHAR, '<null>') || ':' || copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM copies)
"""
QUERY_SQL = SQL.format(docs="documents", cols="doc_id, text, lang, source, n_chars")
