"""Near-duplicate documents by an LSH forest.

Each document's set of word shingles is hashed to ``TREES`` short MinHash signatures of ``DEPTH`` values.  Every
tree is a sorted order of signatures; documents that agree in the first ``ROOT`` values of a tree make up a region.
Depth adapts by region: one of more than ``REGION`` documents is deepened by the next value, and so are its parts, down to
``DEPTH`` values.  Inside a region a document's candidates are its neighbours in the order, which are those with the longest
common prefix: the ``WINDOW`` next ones and the region's least document, so in a region of at most ``WINDOW`` + 1 all
meet.  Candidates are confirmed on full sets.

Confirmation in three rounds: first each document with the candidate it shares most trees with, which already joins
most groups; then all candidates that still lie in different components; then, in every region denser than the
window, all pairs that still lie in different components (``crowd_links``).  A candidate inside one component
cannot change the result and isn't looked at.

The third round is exact: a region is split into blocks of bounded mass by a salt and every pair of blocks is one
group of rows.  A pair is passed over only if its sizes or the parity bitmaps of its sets prove it is not similar
enough, or if links already confirmed connect it; all others are compared on full sets.  Its cost is quadratic in a
region's different texts that stay apart.

Equal sets are one class from the start (128-bit hash of the set), so copies, however many, cost a row each.
Regions are keyed by tree and prefix: a region can be large only if that many *different* texts resemble each
other; deepening spreads it over tasks, and each is streamed.  Recall of a link at similarity s, by one tree alone, is
s ** ROOT: at 0.8 and 24 trees a link is missed with probability 6e-6, however dense its regions are.

Nulls and edges: empty or null text has no set: 0 shingles, its own component.  A null ``doc_id`` is linked with
nothing, component null, kept.  Rows that share a ``doc_id`` are versions of one document: linked with each other
and all kept or not together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, bound_batches, grams, materialise_lean, mix, prefix_sums, runs, span_hashes, utf8_blocks
from .components import components

TREES = 24
DEPTH = 6
ROOT = 3
WINDOW = 12
#: Documents of a region beyond which it is deepened.
REGION = 1024
#: Mass of a block of a dense region: shingles, and as many as ``ROW_MASS`` for each document besides.
BLOCK_MASS = 1 << 20
ROW_MASS = 256


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240117)
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    data = LOWER[data]
    s, e, doc = runs(data, offsets, NOT_SPACE)
    h = span_hashes(prefix_sums(data), s, e)
    g, at = grams(h, doc, words)
    gdoc = doc[at]
    n = len(offsets) - 1
    bounds = np.searchsorted(gdoc, np.arange(n + 1))
    wbounds = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for d in range(n):
        if bounds[d + 1] > bounds[d]:
            out.append(np.unique(g[bounds[d] : bounds[d + 1]]))
        else:
            w = h[wbounds[d] : wbounds[d + 1]]
            if len(w):  # too few words: the whole sequence as one
                x, _ = grams(w, np.zeros(len(w), np.int64), len(w))
                out.append(mix(x, len(w)))
            else:
                out.append(w)
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    a = int(np.sum(mix(s, 1), dtype=np.uint64).view(np.int64))
    b = int(np.sum(mix(s, 2), dtype=np.uint64).view(np.int64))
    return a, b


def _sign(words: int, trees: int, depth: int):
    mul, add = _multipliers(trees * depth)

    def signature(s: np.ndarray) -> bytes:
        low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        for i in range(0, len(x), 256):
            y = x[i : i + 256, None] * mul + add
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(low, y.min(axis=0), out=low)
        return low.astype(">u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in utf8_blocks(b.column(1)):
                sets = shingle_sets(data, offsets, words)
                keys = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _neighbours(window: int):
    """Rows arrive in the order of (region, signature); yields candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, head, recent = None, 0, []
        for b in batches:
            one, two = [], []
            for r, c, first in zip(b.column("region").to_pylist(), b.column("cid").to_pylist(), b.column("head").to_pylist()):
                if r != region:
                    region, head, recent = r, first, []
                for o in recent:
                    one.append(max(o, c))
                    two.append(min(o, c))
                if head != c and head not in recent:
                    one.append(c)
                    two.append(head)
                recent.append(c)
                if len(recent) > window:
                    recent.pop(0)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return run


def _confirm(words: int, percent: int):
    """Rows (a, b, text of b, texts of a): yields the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in batches:
            ok = []
            for k, (a, ta, tb) in enumerate(zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb"))):
                ta, tb = ta.as_py().encode(), tb.as_py().encode()
                if last != (a, ta):
                    last, mine = (a, ta), _one_set(ta, words)
                other = _one_set(tb, words)
                if not len(mine) or not len(other):
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    ok.append(k)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok, pa.int64())), b.column("b").take(pa.array(ok, pa.int64()))], ["a", "b"])

    return run


class _Block:
    """The held documents of a block, and which of them are connected as far as known."""

    def __init__(self, widest: int, percent: int):
        self.bits = min(max(512, 1 << int(2 * widest).bit_length()), 1 << 16)
        self.percent = percent
        self.maps = np.zeros((64, self.bits // 64), np.uint64)
        self.sizes, self.labels = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.parent: dict[int, int] = {}

    def bitmap(self, s: np.ndarray) -> np.ndarray:
        """Bit by bit the parity of the elements there: two maps differ in at most as many bits as their sets in elements."""
        odd = np.bincount((s & np.uint64(self.bits - 1)).astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.uint64)

    def label(self, root: int) -> int:
        while root in self.parent:
            root = self.parent[root]
        return root

    def links(self, root: int, s: np.ndarray, bitmap: np.ndarray) -> list[int]:
        """Held documents that ``s`` is linked with, enough of them to connect all it is similar to."""
        n, p, out = len(self.ids), self.percent, []
        mine, size = self.label(root), len(s)
        sizes = self.sizes[:n]
        near = np.flatnonzero((self.labels[:n] != mine) & (100 * np.minimum(sizes, size) >= p * np.maximum(sizes, size)))
        if not len(near):
            return out
        apart = np.bitwise_count(self.maps[near] ^ bitmap).sum(1, dtype=np.int64)
        may = (100 + p) * apart <= (100 - p) * (sizes[near] + size)
        near = near[may][np.argsort(apart[may], kind="stable")]
        for x in near:
            theirs = self.labels[x]
            if theirs == mine:
                continue
            both = len(np.intersect1d(s, self.sets[x], assume_unique=True))
            if 100 * both >= p * (size + len(self.sets[x]) - both):
                out.append(self.ids[x])
                self.parent[int(theirs)] = mine
                self.labels[:n][self.labels[:n] == theirs] = mine
        return out

    def hold(self, cid: int, root: int, s: np.ndarray, bitmap: np.ndarray) -> None:
        n = len(self.ids)
        if n == len(self.sizes):
            self.maps = np.concatenate([self.maps, np.zeros_like(self.maps)])
            self.sizes, self.labels = np.append(self.sizes, np.zeros_like(self.sizes)), np.append(self.labels, np.zeros_like(self.labels))
        self.maps[n], self.sizes[n], self.labels[n] = bitmap, len(s), self.label(root)
        self.ids.append(cid)
        self.sets.append(s)


def _all_pairs(words: int, percent: int):
    """Rows arrive by (region, one, two) and then by block, the held one first; yields confirmed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, None
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("region", "one", "two", "mine", "cid", "root", "widest")))
            sets = (s for _, _, data, offsets in utf8_blocks(batch.column("text")) for s in shingle_sets(data, offsets, words))
            for (region, one, two, mine, cid, root, widest), s in zip(rows, sets):
                if (region, one, two) != group:
                    group, block = (region, one, two), _Block(widest, percent)
                if not len(s):
                    continue
                bitmap = block.bitmap(s)
                if one == two or mine == two:
                    found = block.links(root, s, bitmap)
                    a += [cid] * len(found)
                    b += found
                if mine == one:
                    block.hold(cid, root, s, bitmap)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def deepened(tree: DataFrame, levels: int, limit: int) -> DataFrame:
    """``tree`` (cid, region, rest) with regions of more than ``limit`` documents parted by the next values of ``rest``, level by level.

    Adds ``head``, the region's least document; regions of one are left out.  Each level counts by region, with
    map-side combining, and only rows of regions that were too large go on to the next.
    """
    done = None
    for level in range(levels + 1):
        sizes = tree.groupBy("region").agg(F.count("*").alias("__n"), F.min("cid").alias("head")).where("__n > 1")
        sized = tree.join(sizes.hint("merge"), "region")
        last = level == levels
        fits = (sized if last else sized.where(F.col("__n") <= limit)).drop("__n")
        done = fits if done is None else done.unionByName(fits)
        if not last:
            deeper = F.xxhash64("region", F.lit(level), F.substring("rest", 4 * level + 1, 4))
            tree = sized.where(F.col("__n") > limit).select("cid", deeper.alias("region"), "rest")
    return done


def crowd_links(tree: DataFrame, roots: DataFrame, docs: DataFrame, words: int, percent: int, window: int, block_mass: int = BLOCK_MASS) -> DataFrame:
    """Links between the components ``roots`` (node, root) that join all similar documents of any region denser than the window.

    ``tree``: (cid, n, region), n being the number of shingles.
    """
    now = roots.select(F.col("node").alias("cid"), "root").hint("merge")
    rooted = tree.join(now, "cid", "left").select("region", "cid", "n", F.coalesce("root", "cid").alias("root"))
    dense = (
        rooted.groupBy("region")
        .agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("n") + ROW_MASS).alias("mass"), F.max("n").alias("widest"))
        .where((F.col("m") > window + 1) & (F.col("lo") != F.col("hi")))
        .select("region", F.ceil(F.col("mass") / block_mass).cast("int").alias("blocks"), "widest")
    )
    # Written before texts join, so that the shuffles of regions don't lie on disk beside those of texts.
    crowded = materialise_lean(rooted.join(dense.hint("merge"), "region"), "crowded")
    rows = crowded.withColumn("mine", F.pmod(F.xxhash64("cid", "region"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("region", "cid", "root", "widest", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    full = rows.join(docs.select(F.col("doc_id").alias("cid"), "text").hint("merge"), "cid")
    grouped = full.repartition("region", "one", "two").sortWithinPartitions("region", "one", "two", "mine", "root", "cid")
    found = grouped.select("region", "one", "two", "mine", "cid", "root", "widest", "text").mapInArrow(_all_pairs(words, percent), "a long, b long")
    return found.where("a <> b").distinct()


def _one_set(text: bytes, words: int) -> np.ndarray:
    return shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)[0]


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b: doc_ids) whose shingle sets reach the similarity; a text travels once for each of its pairs.

    Both sides grow with the corpus, so the joins are merge joins at every size.
    """
    texts = texts.hint("merge")
    lesser = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    full = lesser.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def link(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, root: int = ROOT, window: int = WINDOW, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs`` (``doc_id`` long, ``text``)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise_lean(docs.mapInArrow(_sign(words, trees, depth), "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    by_set = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("cid"), F.min("sig").alias("sig"))
    classes = materialise_lean(by_set, "classes")
    spans = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("byte").alias("t"), F.substring(F.col("sig"), t * 4 * depth + 1, F.lit(4 * depth)).alias("s")))
    tree = classes.select("cid", "n", F.explode(spans).alias("x")).select("cid", "n", F.xxhash64(F.col("x.t"), F.substring("x.s", 1, 4 * root)).alias("region"), F.substring("x.s", 4 * root + 1, 4 * (depth - root)).alias("rest"))
    sorted_trees = deepened(tree.select("cid", "region", "rest"), depth - root, region).repartition("region").sortWithinPartitions("region", "rest", "cid")
    found = sorted_trees.select("region", "cid", "head").mapInArrow(_neighbours(window), "a long, b long")
    pairs = materialise_lean(found.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")

    used = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialise_lean(docs.join(used.hint("merge"), "doc_id"), "pair-texts")  # only documents with candidates
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    first = materialise_lean(confirm(best, texts, words, percent), "links")
    # Versions of one document belong together, whatever their sets.
    members = usable.join(classes.select("h1", "h2", "n", "cid").hint("merge"), ["h1", "h2", "n"]).select("doc_id", "cid", "h1")
    versions = usable.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id")
    same = members.join(versions, "doc_id").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    first = first.unionByName(same)
    roots = components(first)
    left = (
        pairs.join(best, ["a", "b"], "left_anti")
        .join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b")
    )
    left = materialise_lean(left, "left")
    second = confirm(left, texts, words, percent)
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    third = materialise_lean(crowd_links(tree.select("cid", "n", "region"), final, docs, words, percent, window), "crowd-links")
    if not third.isEmpty():
        final = components(final.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(third))
    # A class that no link reaches is its own component; documents follow their class.
    of_class = classes.join(final, F.col("cid") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("root", "cid").alias("root"))
    out = signed.join(of_class.hint("merge"), ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    out = link(docs, words=4)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document of least ``doc_id``, one row of it."""
    kept = link(docs, words, percent)
    gone = kept.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").cast("long").alias("__id"))
    # Whole rows are shuffled once: the hash join leaves them where the window wants them, and rows without an id stay where they are.
    stay = rows.where("__id IS NOT NULL").join(gone.hint("shuffle_hash"), F.col("__id") == F.col("__gone"), "left_anti")
    order = Window.partitionBy("__id").orderBy(F.xxhash64("__doc"))
    one = stay.withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return one.select("__doc.*").unionByName(rows.where("__id IS NULL").select("__doc.*"))


#: Words by splitting; shingle sets, all pairs of documents that share a shingle, then components.
QUERY_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i+3], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.node = d.doc_id
"""
