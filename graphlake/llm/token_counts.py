"""Token counts as rollups that are maintained by deltas.

Totals by source, language and tokenizer version are additive, so a batch of changes becomes signed rows: +1 and
+tokens for an insert, -1 and -tokens for a delete, both for a revised document.  A batch is aggregated
first (map-side combining; a hot source costs one row per task) and then added to the totals.  A commit writes a
new version of the totals and then a marker, written aside and renamed: it is there whole or not at all.  Its name holds
version and batch, so a listing tells what was committed, and a batch that was isn't added again: a batch may be
replayed after any failure.  What isn't a whole marker is no commit.

Tokenizers: ``words`` (runs of non-blank characters) and ``utf8`` (bytes) are native expressions; a vocabulary
file of ranks (its path is a parameter) gives byte-pair counts.

Nulls and edges: null text counts 0 tokens and one document; a null source or language is a group of its own;
repeated rows count each; a null ``op`` is an insert, an unknown one an error, and so is a revision without a column
``old_text`` (null there is a null text); groups whose documents fall to
zero go. An empty batch is committed and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extend, shared_dir

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens"]
NATIVE: dict[str, object] = {
    "words-v1": lambda t: F.when(t.isNull(), F.lit(0)).otherwise(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))),
    "utf8-v1": lambda t: F.coalesce(F.octet_length(t), F.lit(0)),
}
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _bpe(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = pa.array([len(coder.encode_ordinary(t)) if t else 0 for t in b.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "__bpe"])

    return run


def changes(feed: DataFrame, tokenizers: list[str], ranks: dict[str, str] | None = None) -> DataFrame:
    """Signed rows from a change feed with ``source``, ``lang``, ``text``, ``op`` (insert, delete or revise) and, for revised rows, ``old_text``, ``old_source``, ``old_lang``.

    ``ranks``: path of the vocabulary by tokenizer version.
    """
    has = {c.lower() for c in feed.columns}
    op = F.coalesce(F.col("op"), F.lit("insert")) if "op" in has else F.lit("insert")
    op = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown op "), op)))
    if "old_text" not in has:
        op = F.when(op == "revise", F.raise_error(F.lit("a revision needs old_text"))).otherwise(op)
    old = {c: F.col(f"old_{c}") if f"old_{c}" in has else F.lit(None).cast("string") if c == "text" else F.col(c) for c in ("source", "lang", "text")}
    side = lambda sign, cols: F.struct(F.lit(sign).alias("sign"), *[c.cast("string").alias(k) for k, c in cols.items()])
    now = {c: F.col(c) for c in ("source", "lang", "text")}
    both = F.when(op == "insert", F.array(side(1, now))).when(op == "delete", F.array(side(-1, now))).otherwise(F.array(side(1, now), side(-1, old)))
    rows = feed.select(F.explode(both).alias("__c")).select("__c.sign", "__c.source", "__c.lang", F.col("__c.text").alias("__text"))
    out = None
    native = [v for v in tokenizers if v in NATIVE]
    if native:
        counts = F.array(*[F.struct(F.lit(v).alias("tokenizer"), NATIVE[v](F.col("__text")).cast("long").alias("n")) for v in native])
        out = rows.select("sign", "source", "lang", F.explode(counts).alias("c")).select("sign", "source", "lang", "c.tokenizer", "c.n")
    for v in tokenizers:
        if v not in NATIVE:
            coded = rows.mapInArrow(_bpe((ranks or {})[v]), extend(rows.schema, "__bpe long")).select("sign", "source", "lang", F.lit(v).alias("tokenizer"), F.col("__bpe").alias("n"))
            out = coded if out is None else out.unionByName(coded)
    return out.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder of the shared file system; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> list[tuple[int, str]]:
        """(version, name) of whole markers; torn ones, which no rename leaves, have no content."""
        at = self._Path(f"{self.path}/_commits")
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((int(n[1:9]), n) for n, size in found if re.fullmatch(r"v\d{8}-[0-9a-f]{32}", n) and size)

    def _read(self, name: str) -> dict:
        f = self._fs.open(self._Path(f"{self.path}/_commits/{name}"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def committed(self) -> list[str]:
        return [self._read(n)["batch"] for _, n in self._markers()]

    def totals(self) -> DataFrame:
        if m := self._markers():
            return self.spark.read.parquet(f"{self.path}/{self._read(m[-1][1])['data']}")
        return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch's signed rows; False if the batch was committed before."""
        done, mine = self._markers(), hashlib.md5(batch.encode()).hexdigest()
        if any(n.endswith(mine) for _, n in done):
            return False
        version = done[-1][0] + 1 if done else 0
        data = f"totals-{version:08d}-{uuid.uuid4().hex}"
        total = self.totals().unionByName(delta.select(*KEYS, *MEASURES)).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        total.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{self.path}/{data}")
        aside, to = (self._Path(f"{self.path}/_commits/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{version:08d}-{mine}"))
        f = self._fs.create(aside, False)
        f.write(bytearray(json.dumps({"batch": batch, "data": data}).encode()))
        f.close()
        if [v for v, _ in self._markers()] != [v for v, _ in done]:
            raise RuntimeError(f"another writer committed version {version}")
        self._fs.delete(to, False)
        if not self._fs.rename(aside, to):
            raise RuntimeError(f"batch {batch} could not be committed")
        return True


TOKENIZERS = ["words-v1", "utf8-v1"]


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    rollup.commit("all-documents", changes(docs, TOKENIZERS))
    # Every document is revised, the revision replayed (which must change nothing), then deleted and inserted again.
    other = F.concat(F.lit("revised "), F.coalesce("text", F.lit("")))
    keys = [F.col("source"), F.col("lang")]
    revised = changes(docs.select(*keys, other.alias("text"), F.col("text").alias("old_text"), F.lit("revise").alias("op")), TOKENIZERS)
    rollup.commit("revised", revised)
    rollup.commit("revised", revised)
    rollup.commit("gone", changes(docs.select(*keys, other.alias("text"), F.lit("delete").alias("op")), TOKENIZERS))
    rollup.commit("again", changes(docs, TOKENIZERS))
    return rollup.totals()


QUERY_SQL = r"""
SELECT source, lang, 'words-v1' AS tokenizer, count(*) AS n_docs, coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0)::BIGINT AS n_tokens
FROM documents GROUP BY source, lang
UNION ALL
SELECT source, lang, 'utf8-v1', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM documents GROUP BY source, lang
"""
