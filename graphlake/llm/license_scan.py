"""Licence scan by diagonal voting.

Every rolling window of ``k`` words of every text is hashed and joined to the positions of the templates' windows.
A hit at text word *p* and template word *q* votes for the diagonal *p - q*; votes are summed by diagonal,
diagonals next to each other (up to ``slack`` words inserted or left out) are merged into one span, spans of a
template that follow each other in text and template, at most ``gap`` words apart, are chained (a name or a copyright
line put in), and a chain is verified: its hits carry the words themselves, so only equal wordings count, and the
template words they cover must be ``coverage`` of the template.

The templates are a fixed list (some hundreds of words); their windows are the build side of a broadcast
join.  Ahead of the join, windows whose hash isn't among the templates' are left out where they arise, as a
runtime filter of the same join would do.

Nulls and edges: a null text is empty; repeated rows are reported each; a null ``doc_id`` stays null; a template
of fewer than ``k`` words can't be found and is refused.  Ties: of diagonals merged, the smallest comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, extend, grams, prefix_sums, runs, span_hashes, utf8_blocks
from .license_templates import TEMPLATES

K = 4
SLACK = 3
GAP = 30
COVERAGE = 0.6
BASE = [("apache license", "apache"), ("general public license", "gpl"), ("mit license", "mit")]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_ASCII_LOWER))


def _hash_words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = runs(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(prefix_sums(data), s, e)


def template_windows(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, str, int, int, str]]:
    """(hash, template, label, template's words, position, words) of every window of every template."""
    out = []
    for t, (label, text) in enumerate(templates):
        words, h = words_of(text), _hash_words(text)
        if len(words) < k:
            raise ValueError(f"template {t} has fewer than {k} words")
        g, _ = grams(h, np.zeros(len(h), np.int64), k)
        out += [(int(x.view(np.int64)), t, label, len(words), q, " ".join(words[q : q + k])) for q, x in enumerate(g)]
    return out


def _scan(wanted: np.ndarray, k: int):
    phrases = [(_hash_words(p), label) for p, label in BASE]
    bits = np.zeros(1 << 20, bool)
    bits[wanted & np.uint64((1 << 20) - 1)] = True
    struct = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in utf8_blocks(b.column(1)):
                n = j - i
                data = LOWER[data]
                s, e, doc = runs(data, offsets, ALNUM)
                h = span_hashes(prefix_sums(data), s, e)
                first_of = np.searchsorted(doc, np.arange(n + 1))
                n_base = np.zeros(n, np.int64)
                lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels = [[] for _ in range(n)]
                for p, label in phrases:
                    m = len(h) - len(p) + 1
                    if m <= 0:
                        continue
                    hit = doc[:m] == doc[len(p) - 1 :]
                    for q, x in enumerate(p):
                        hit = hit & (h[q : m + q] == x)
                    at = np.flatnonzero(hit)
                    d, w = doc[at], at - first_of[doc[at]]
                    n_base += np.bincount(d, minlength=n)
                    np.minimum.at(lo, d, w)
                    np.maximum.at(hi, d, w)
                    for x in np.unique(d):
                        labels[x].append(label)
                g, at = grams(h, doc, k)
                maybe = np.flatnonzero(bits[g & np.uint64((1 << 20) - 1)])
                maybe = maybe[np.isin(g[maybe], wanted)]
                hits: list[list[dict]] = [[] for _ in range(n)]
                for x in maybe:
                    w = at[x]
                    said = " ".join(data[s[w + y] : e[w + y]].tobytes().decode() for y in range(k))
                    hits[doc[w]].append({"hash": int(g[x].view(np.int64)), "at": int(w - first_of[doc[w]]), "words": said})
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(i, n) for c in (0, 2)),
                        pa.array(np.diff(first_of)),
                        pa.array(n_base),
                        pa.array(lo, mask=none),
                        pa.array(hi, mask=none),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array(hits, struct),
                    ],
                    ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"],
                )

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = SLACK, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """One row per document: base numbers and ``spans``, an array of (label, template, start, end, score) in words."""
    spark = docs.sparkSession
    windows = template_windows(templates, k)
    wanted = np.unique(np.array([w[0] for w in windows], np.int64).view(np.uint64))
    known = spark.createDataFrame(windows, "hash long, template int, label string, length int, q int, words string")
    given = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("t"), F.monotonically_increasing_id().alias("row"))
    ddl = "row long, n_words long, n_base long, first_word long, last_word long, base_labels string, hits array<struct<hash:long,at:long,words:string>>"
    digest = given.mapInArrow(_scan(wanted, k), extend(given.select("doc_id").schema, ddl))
    base = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    hit = digest.select(*base, F.explode_outer("hits").alias("hit"))
    same = (F.col("hit.hash") == F.col("hash")) & (F.col("hit.words") == F.col("words"))
    votes = (
        hit.join(F.broadcast(known), same, "left")
        .groupBy(*base, "template", "label", "length", (F.col("hit.at") - F.col("q")).alias("diagonal"))
        .agg(F.min("hit.at").alias("lo"), F.max("hit.at").alias("hi"), F.collect_set("q").alias("qs"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    merged = (
        votes.withColumn("group", F.sum(F.coalesce(fresh, F.lit(0))).over(order))
        .groupBy(*base, "template", "label", "length", "group")
        .agg(F.min("lo").alias("start"), (F.max("hi") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    )
    # Spans go on with the chain if they come soon after it in the text and later than it in the template.
    by_place = Window.partitionBy("row", "template").orderBy("start", "end")
    soon = F.col("start") - F.lag("end").over(by_place) <= gap
    later = F.array_min("qs") > F.lag(F.array_min("qs")).over(by_place)
    merged = (
        merged.withColumn("chain", F.sum(F.when(F.coalesce(soon & later, F.lit(True)), 0).otherwise(1)).over(by_place))
        .groupBy(*base, "template", "label", "length", "chain")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    )
    # A template word is covered if one of the windows that hold it was hit.
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (k - 1))))))
    span = F.struct("label", "template", "start", "end", (covered / F.col("length")).alias("score"))
    return (
        merged.withColumn("span", F.when(F.col("template").isNotNull() & (covered >= F.col("length") * coverage), span))
        .groupBy(*base)
        .agg(F.sort_array(F.collect_list("span")).alias("spans"))
    )


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", labels).alias("labels"), score.alias("score"))


#: The base columns of the query alone, which SQL can tell.
BASE_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
BASE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
p AS (SELECT r, unnest(range(0, len(l))) AS i, unnest(l) AS a, unnest(l[2:]) AS b, unnest(l[3:]) AS c FROM w),
hit AS (
  SELECT r, i, 'mit' AS label FROM p WHERE a = 'mit' AND b = 'license'
  UNION ALL SELECT r, i, 'apache' FROM p WHERE a = 'apache' AND b = 'license'
  UNION ALL SELECT r, i, 'gpl' FROM p WHERE a = 'general' AND b = 'public' AND c = 'license'),
h AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels
FROM w LEFT JOIN h ON h.r = w.r
"""
