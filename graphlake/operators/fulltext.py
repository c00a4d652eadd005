"""Full-text search over node or edge attributes: words with positions, phrases, whole values.

Words are lower-cased runs between blanks, control characters and punctuation; symbols such as ``$ + <`` and the
underscore belong to words.  Positions count from 1.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.graph import Graph

_SPLIT = r"[\s\p{Z}\p{Cc}\p{P}&&[^_]]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def texts(df: DataFrame, attr: str | None = None) -> DataFrame:
    """(key, attr, text) of all attributes, or one; structs by path and as JSON, other values as JSON."""
    pairs: list[tuple[str, Column]] = []

    def walk(name: str, c: Column, t: T.DataType) -> None:
        if isinstance(t, T.BinaryType):
            return
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{name}.{f.name}", c.getField(f.name), f.dataType)
        if attr in (None, name):
            pairs.append((name, c if isinstance(t, T.StringType) else F.to_json(c) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")))

    for f in df.schema.fields:
        if f.name not in ("key", "kind"):
            walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    if not pairs:
        return df.select(F.col("key").cast("string").alias("key"), F.lit("").alias("attr"), F.lit("").alias("text")).limit(0)
    if len(pairs) == 1:
        return df.select(F.col("key").cast("string").alias("key"), F.lit(pairs[0][0]).alias("attr"), pairs[0][1].alias("text")).where("text IS NOT NULL")
    each = F.array(*[F.struct(F.lit(n).alias("attr"), c.alias("text")) for n, c in pairs])
    return df.select(F.col("key").cast("string").alias("key"), F.explode(each).alias("x")).select("key", "x.attr", "x.text").where("text IS NOT NULL")


def index(df: DataFrame, attr: str | None = None) -> DataFrame:
    """(key, attr, word, pos)"""
    return texts(df, attr).select("key", "attr", F.posexplode(word_array(F.col("text"))).alias("p", "word")).select("key", "attr", "word", (F.col("p") + 1).cast("long").alias("pos"))


def lookup_word(df: DataFrame, attr: str, word: str) -> DataFrame:
    """(key, positions).  A plain substring test, which needs no splitting, comes first."""
    t = texts(df, attr).where(F.lower("text").contains(word.lower()))
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at(F.col("w"), i.cast("int")) == word.lower())
    return t.withColumn("w", word_array(F.col("text"))).where(F.array_contains("w", word.lower())).select("key", F.transform(at, lambda i: i.cast("long")).alias("positions"))


def count_word(df: DataFrame, attr: str, word: str) -> DataFrame:
    return lookup_word(df, attr, word).agg(F.count("*").alias("n"))


def lookup_phrase(df: DataFrame, attr: str | None, phrase: str) -> DataFrame:
    """Distinct keys whose text holds the phrase's words one after the other; an empty phrase has none."""
    words = split_words(phrase)
    t = texts(df, attr)
    if not words:
        return t.select("key").limit(0)
    hit = F.concat(F.lit(" "), F.array_join(word_array(F.col("text")), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
    return t.where(F.lower("text").contains(words[0])).where(hit).select("key").distinct()


def split_words(phrase: str) -> list[str]:
    import unicodedata

    out, now = [], ""
    for c in phrase.lower():
        if c != "_" and (c.isspace() or unicodedata.category(c)[0] in "ZP" or unicodedata.category(c) == "Cc"):
            out.append(now)
            now = ""
        else:
            now += c
    return [w for w in [*out, now] if w]


def lookup_value(df: DataFrame, attr: str | None, value: str) -> DataFrame:
    """Distinct keys with an attribute equal to ``value`` but for case."""
    return texts(df, attr).where(F.lower("text") == value.lower()).select("key").distinct()


def edge_texts(graph: Graph, kind: str) -> DataFrame:
    """An edge kind as a table to search: key and attributes without those of the ends."""
    parts = [e.df.select("key", *[F.col(f"`{a}`") for a in e.attrs if a != "key"]) for e in graph.edges if e.kind == kind]
    if not parts:
        raise ValueError(f"Unknown edge kind: {kind}")
    out = parts[0].withColumn("key", F.col("key").cast("string"))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("key", F.col("key").cast("string")), allowMissingColumns=True)
    return out


class StoredIndex:
    """A full-text index in files: each word of a text with its position, and hashes of whole values.

    Texts are spread evenly, so that a task's words fit its memory, and a task writes its words as a file sorted by the word's
    ``hash``: texts are shuffled, words never.  A lookup reads, of each file, the pages whose statistics admit the hash.  A change
    is a table of the keys concerned and one of their new entries; a lookup leaves out what later changes took back, and
    ``compact`` makes one table of all again, with small files packed together.  ``buckets`` is accepted but has no effect: there
    are no folders by word.
    """

    SCHEMA = "at string, key string, word string, pos bigint, hash int"  # at: kind and attribute

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = jvm_path, jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def _entries(self, rows: DataFrame) -> DataFrame:
        """Words of a text and, as its last, the hash of the whole."""
        whole = F.concat(F.lit("\x00"), F.md5(F.lower("text")))
        words = F.posexplode(F.concat(word_array(F.col("text")), F.array(whole))).alias("p", "word")
        at = F.concat_ws("\x00", "kind", "attr").alias("at")
        return rows.hint("rebalance", "key").select(at, "key", words).select("at", "key", "word", (F.col("p") + 1).cast("long").alias("pos"))

    def _put(self, entries: DataFrame, keys: DataFrame | None) -> None:
        """A version is written aside and appears by a rename.  Rows are sorted by one number, hash and position, which Spark does by radix."""
        aside, version = f"{self.path}/_aside-{uuid.uuid4().hex}", (self._versions() or [-1])[-1] + 1
        place = F.shiftleft(F.hash("word").cast("long"), 32).bitwiseOR(F.col("pos"))
        rows = entries.select("at", "key", "word", place.alias("place")).sortWithinPartitions("place")
        rows.select("at", "key", "word", F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos"), F.shiftright("place", 32).cast("int").alias("hash")).write.parquet(f"{aside}/entries")
        if keys is not None:
            keys.write.parquet(f"{aside}/keys")
        self._fs.rename(self._path(aside), self._path(f"{self.path}/v{version:06d}"))

    def build(self, tables: dict[str, DataFrame]) -> StoredIndex:
        """Index all attributes of tables by kind."""
        out = None
        for kind, df in tables.items():
            t = texts(df).select(F.lit(kind).alias("kind"), "key", "attr", "text")
            out = t if out is None else out.unionByName(t)
        self._put(self._entries(out), None)
        return self

    def change(self, kind: str, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """New states of some nodes (or edges) of a kind, and keys of removed ones."""
        keys = rows.select(F.col("key").cast("string").alias("key"))
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col("key").cast("string").alias("key")))
        self._put(self._entries(texts(rows).select(F.lit(kind).alias("kind"), "key", "attr", "text")), keys.select(F.lit(kind).alias("kind"), "key").distinct())

    def _read(self, what: Column | None = None) -> DataFrame:
        """Entries that hold, of all words or where ``what`` holds."""
        versions, changed = self._versions(), None
        for v in versions:
            at = f"{self.path}/v{v:06d}/keys"
            if self._fs.exists(self._path(at)):
                k = self.spark.read.schema("kind string, key string").parquet(at).select(F.concat("kind", F.lit("\x00")).alias("__kind"), F.col("key").alias("__key"), F.lit(v).cast("long").alias("__since"))
                changed = k if changed is None else changed.unionByName(k)
        d = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/v{v:06d}/entries" for v in versions])
        if changed is None:
            return d if what is None else d.where(what)
        d = d.withColumn("__file", F.col("_metadata.file_path"))
        version = F.regexp_extract("__file", r"^.*/v(\d+)/entries/", 1).cast("long")  # in the condition, thus worked out for changed keys only
        later = (F.col("key") == F.col("__key")) & F.startswith(F.col("at"), F.col("__kind")) & (version < F.col("__since"))
        return (d if what is None else d.where(what)).join(changed, later, "left_anti").drop("__file")

    def compact(self) -> None:
        """All that holds as one version; older ones go."""
        old = self._versions()
        self._put(self._read(), None)
        for v in old:
            self._fs.delete(self._path(f"{self.path}/v{v:06d}"), True)

    def _word(self, kind: str, attr: str, word: str) -> DataFrame:
        """(key, pos) of a word."""
        return self._read((F.col("hash") == F.hash(F.lit(word))) & (F.col("word") == word) & (F.col("at") == f"{kind}\x00{attr}")).select("key", "pos")

    def lookup_word(self, kind: str, attr: str, word: str) -> DataFrame:
        """(key, positions)"""
        return self._word(kind, attr, word.lower()).groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def count_word(self, kind: str, attr: str, word: str) -> DataFrame:
        return self.lookup_word(kind, attr, word).agg(F.count(F.lit(1)).alias("n"))

    def lookup_value(self, kind: str, attr: str, value: str) -> DataFrame:
        digest = hashlib.md5(value.lower().encode()).hexdigest()
        return self._word(kind, attr, "\x00" + digest).select("key").distinct()

    def lookup_phrase(self, kind: str, attr: str, phrase: str) -> DataFrame:
        """Keys with the phrase's words one after the other: places of words, shifted to that of the first word, meet.

        Long words, which tend to be rare, come first, so that what meets a frequent word may be small enough to broadcast.
        """
        out = None
        for i, w in sorted(enumerate(split_words(phrase)), key=lambda x: -len(x[1])):
            at = self._word(kind, attr, w).select("key", (F.col("pos") - i).alias("pos"))
            out = at if out is None else out.join(at, ["key", "pos"])
        return self.spark.createDataFrame([], "key string") if out is None else out.select("key").distinct()


def find(graph: Graph, text: str, value: bool = False) -> DataFrame:
    """(kind, key) of all nodes with a phrase (or whole value) in any attribute."""
    parts = [(lookup_value if value else lookup_phrase)(d, None, text).select(F.lit(k).alias("kind"), "key") for k, d in graph.nodes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
