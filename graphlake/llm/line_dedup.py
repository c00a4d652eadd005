"""Line de-duplication with DataFrame functions only.

Lines are exploded once with their keys (stripped, A-Z lower-cased), keys are hashed to 128 bits and written as a table (what
counting and judging both read); documents are counted per hash, and lines whose key is found in ``min_docs`` documents go, except in the largest ``doc_id`` that holds
it.  What travels is hashes and numbers; the text itself moves once, when the numbers of the lines to drop come
back to their document, whose other positions (a hashed set difference, linear in the lines) are put together again.

Hot keys: hashes are aggregated to one row per key and ``doc_id``, then to one per key, both with map-side
combining; no list of documents is ever built.  A row is known by ``doc_id`` and the hash of its text, so that it is
found again whatever the partitioning.

Nulls and edges: null or empty text is one empty line (too short for a key); rows that share a ``doc_id`` count
as one document, and what one of them drops by key is decided alike for all; a null ``doc_id`` takes no part:
it counts for no key and keeps all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _key(line):
    return F.translate(F.trim(line, F.lit(BLANK)), _UPPER, _UPPER.lower())


def _hash(key):
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (struct ``__doc``) with ``n_lines``, ``n_dropped`` and the remaining text, ``kept_text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").alias("__id"), _hash(text).alias("__row"), text.alias("__text"))
    lines = rows.where("__id IS NOT NULL").select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    long = lines.where(F.char_length("line") >= min_chars).withColumn("key", _key(F.col("line"))).where(F.char_length("key") >= min_chars)
    keyed = materialise(long.select("__id", "__row", "pos", _hash(F.col("key")).alias("h")), "line-keys")
    often = (
        keyed.groupBy("h", "__id").agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.count("*").alias("n"), F.max("__id").alias("last"))
        .where(F.col("n") >= min_docs)
    )
    gone = keyed.join(often, "h").where(F.col("__id") < F.col("last")).groupBy("__id", "__row").agg(F.collect_set("pos").alias("gone"))
    return (
        rows.join(gone, ["__id", "__row"], "left")
        .withColumn("__lines", F.split("__text", "\n", -1))
        .select(
            "__doc",
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.col("__text"))
            .otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone")), lambda i: F.col("__lines")[i]), "\n"))
            .alias("kept_text"),
        )
    )


def query(docs: DataFrame) -> DataFrame:
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select(F.col("__doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERY_SQL = r"""
WITH lines AS (
  SELECT rowid_, doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rowid_, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
        FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, o.last IS NOT NULL AND l.doc_id < o.last AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, coalesce(sum(gone::INT), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM judged GROUP BY rowid_
"""


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text in ``text`` (and its length in ``n_chars``, if there is such a column)."""
    out = drop_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
