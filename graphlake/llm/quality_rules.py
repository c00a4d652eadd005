"""Quality rules: base text statistics and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` cells.  Two multinomials over the cells are fitted: one on the
trusted target (all documents labelled good and not toxic), one on the whole raw corpus.  A document's score is the mean over
its cells of ``log((target + a) / (expected + a))``, where *expected* is the count the raw multinomial gives for a
sample of the target's size, so that cells with little evidence weigh nothing.  The cut is fitted on all
labelled documents (at most ``FALSE_REJECTS`` of the good ones may fall below) and is then the same for every document.

Bounds: cells are fixed (vectors of ``BUCKETS`` numbers are what reaches the driver), and so is the bitmap of ``BITS`` hashed ids that
leaves out most documents without a label before the rest meet the labels in a join.  Cuts are found by a histogram of scores and in
one bin of it.

Nulls and edges: a null text has no words and fails; a null ``doc_id`` is scored like any other and is never
taken as labelled; repeated rows are scored each; label rows with nulls don't count, of repeated labels
the lowest quality and highest toxicity holds; without labels no document falls by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, bound_batches, extend, grams, materialise, mix, prefix_sums, runs, span_hashes, utf8_blocks

BUCKETS = 1 << 18
BITS = 25
BINS = 1 << 12
FALSE_REJECTS = 0.002
PRIOR = 4.0
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_NOT_NEWLINE = np.arange(256) != 0x0A


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found in its document earlier; is it found there twice or more."""
    k = keys ^ mix(doc.astype(np.uint64), 7)
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, often = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order], often[order] = same, twice
    return later, often


def _words(data, offsets):
    s, e, doc = runs(data, offsets, NOT_SPACE)
    sums = prefix_sums(data)
    return s, e, doc, span_hashes(sums, s, e), sums


def _cells(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = grams(h, doc, 2)
    return np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1), np.concatenate([doc, doc[at]])


def base_statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The per-document base numbers, with the words' hashes and documents for reuse."""
    n = len(offsets) - 1
    s, e, doc, h, sums = _words(data, offsets)
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = _per_doc(NOT_SPACE[data] & _LEAD[data], offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[data], offsets)
    ls, le, ldoc = runs(data, offsets, _NOT_NEWLINE)
    inked = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    ink = inked[le] > inked[ls]
    ls, le, ldoc = ls[ink], le[ink], ldoc[ink]
    later, _ = _seen_before(span_hashes(sums, ls, le), ldoc)
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n)
    tri, at = grams(h, doc, 3)
    _, often = _seen_before(tri, doc[at])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[often] + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out, h, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, data, offsets in utf8_blocks(b.column("t")):
            _, _, doc, h, _ = _words(data, offsets)
            total += np.bincount(_cells(h, doc)[0].astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def _maybe(bitmap: np.ndarray):
    """Rows whose id's bit is set: all labelled ones, and some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("d")
            bit = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)
            yes = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            yield b.filter(pa.array((yes > 0) & ~np.asarray(ids.is_null())))

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids to (byte, its bits), each byte once a batch."""
    for b in batches:
        bit = np.unique(mix(b.column("d").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        at, first = np.unique(bit >> 3, return_index=True)
        some = np.bitwise_or.reduceat(1 << (bit & 7), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(some)], ["at", "bits"])


_OUT = "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _score(table: np.ndarray, text: str | None = None):
    """Base numbers and score beside a row's other columns; its text is the last column, or the field ``text`` of the only one."""
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = b.num_columns - (text is None)
            for i, j, data, offsets in utf8_blocks(b.column(0).field(text) if text else b.column(others)):
                stats, h, doc = base_statistics(data, offsets)
                cell, cdoc = _cells(h, doc)
                total = np.bincount(cdoc, weights=table[cell.astype(np.int64)], minlength=j - i)
                score = total / np.maximum(1, np.bincount(cdoc, minlength=j - i))
                cols = [b.column(k).slice(i, j - i) for k in range(others)]
                arrays = [*cols, pa.array(stats["n_words"]), *(pa.array(stats[k]) for k in names), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:others], "n_words", *names, "score"])

    return run


def labelled(labels: DataFrame) -> DataFrame:
    """A row (d, good, trusted) of each labelled document."""
    rows = labels.select(F.col("doc_id").cast("long").alias("d"), F.col("quality").alias("q"), F.col("toxic").alias("t")).dropna()
    return rows.groupBy("d").agg((F.min("q") > 0).alias("good"), ((F.min("q") > 0) & (F.max("t") == 0)).alias("trusted"))


def bitmap_of(known: DataFrame) -> np.ndarray:
    """``2**BITS`` bits as bytes, set where an id of ``known`` is hashed to."""
    got = known.select("d").mapInArrow(_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _counted(docs: DataFrame) -> np.ndarray:
    got = docs.mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def llr_table(docs: DataFrame, some: DataFrame, known: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each cell, from the counts over all of ``docs`` and over the trusted ones among ``some``."""
    trusted = known.where("trusted").select("d").hint("merge")  # labels grow with the corpus: one method at every size
    raw, target = _counted(docs), _counted(some.join(trusted, "d", "left_semi"))
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def threshold(scored: DataFrame) -> float:
    """The highest cut below which at most ``FALSE_REJECTS`` of the good rows fall, and not above the rest's need; of (good, score)."""
    bins = scored.groupBy("good", F.floor(F.col("score") * BINS).alias("bin")).count().toPandas()
    good = bins[bins["good"]].sort_values("bin")
    if not len(good) or len(good) == len(bins):
        return float("-inf")
    before = np.cumsum(good["count"].to_numpy(np.int64))
    k = int(FALSE_REJECTS * before[-1])
    at = int(np.searchsorted(before, k, "right"))
    where = F.floor(F.col("score") * BINS) == int(good["bin"].iloc[at])
    cut = scored.where("good").where(where).select("score").orderBy("score").offset(k - int(before[at - 1]) if at else k).limit(1).first()[0]
    below = scored.where(~F.col("good") & (F.col("score") < cut)).agg(F.max("score")).first()[0]
    return float("-inf") if below is None else (below + cut) / 2


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All of ``docs`` (``doc_id``, ``text``; or the columns ``keep``) with base numbers, ``llr``, ``base_failed``, ``kept``."""
    bound_batches(docs.sparkSession)
    known = materialise(labelled(labels), "labelled")
    ids = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("t"))
    maybe = _maybe(bitmap_of(known))
    some = ids.mapInArrow(maybe, ids.schema)
    table = llr_table(ids, some, known)
    schema = "n_words long, " + _OUT + ", score double"
    score = _score(table)
    met = ids.mapInArrow(lambda batches: score(maybe(batches)), extend(ids.select("d").schema, schema))  # one Python worker a task
    cut = threshold(materialise(met.where("n_words > 0").join(known.hint("merge"), "d").select("good", "score"), "labelled-scores"))
    keep = keep or ["doc_id"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"), F.col("text").cast("string").alias("__t"))
    if "text" in keep and ("text", "string") in docs.dtypes:  # it goes to Python once
        scored = whole.select("__doc").mapInArrow(_score(table, "text"), extend(whole.select("__doc").schema, schema))
    else:
        scored = whole.mapInArrow(score, extend(whole.select("__doc").schema, schema))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(cut)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("score").alias("llr")]
    return score_documents(docs, labels).select("__doc.doc_id", *cols)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return score_documents(docs, labels, docs.columns).where("kept").select("__doc.*")


#: The base columns of the query alone, which SQL can tell.
BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
tri AS (SELECT r, unnest(range(1, len(l) - 1)) AS i, l FROM w WHERE len(l) > 2),
seen AS (SELECT r, i, count(*) OVER (PARTITION BY r, l[i], l[i + 1], l[i + 2]) AS n FROM tri),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM seen, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, x, count(*) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r, x) GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(l) AS base_failed
FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN dup ON dup.r = w.r
"""
