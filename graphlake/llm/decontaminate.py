"""Benchmark decontamination by the q-gram lemma.

Text and items are normalised (lower-cased, everything ASCII but letters and digits one blank).  An item of m
characters with at most k edits, k = floor(m * EDITS), leaves at least m + 1 - Q * (k + 1) of its q-grams, on
diagonals at most k apart.  So: (1) stretches of text that hold too few q-grams of *any* item of that length
class are passed over; (2) in the others q-grams shared with each item are counted in overlapping bands of
diagonals, each twice as wide as the step, so that every match lies whole in one; (3) bands that reach the item's
bound are verified by banded alignment of the whole item.  No step can lose a match.

The index of items is a lookup table in every task; it is built for at most ``INDEX_BYTES`` of items at a time and a
larger benchmark is taken in such blocks, each against all documents.

Nulls and edges: null or empty text or item matches nothing; a null ``doc_id`` or ``item_id`` is reported as
null; items shorter than ``Q`` + 1 normalised bytes are no evidence and are left out; repeated rows are reported
each.  Of several places of an item in a document the best is given (fewest edits, then first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, extend, utf8_blocks

Q = 8
EDITS = 0.05
INDEX_BYTES = 8 << 20
_MAP = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their documents' offsets, and where each byte stood."""
    x = _MAP[data]
    blank = x == 0x20
    twice = blank.copy()
    twice[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    twice[first] = blank[first]  # no blank at the start
    at = np.flatnonzero(~twice)
    return x[at], np.searchsorted(at, offsets), at


def normalised(text: str | None) -> bytes:
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    return normalise(data, np.array([0, len(data)]))[0].tobytes().strip(b" ")


def _codes(x: np.ndarray) -> np.ndarray:
    """The 8-byte q-grams themselves as numbers."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    c = x.astype(np.uint64)
    for span in (1, 2, 4):
        c = (c[:-span] << np.uint64(8 * span)) | c[span:]
    return c


def _slot(c: np.ndarray) -> np.ndarray:
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole item in ``text`` on diagonals low..high, or None if over ``most``."""
    low, high = low - most, high + most
    width = high - low + 1
    big = most + 1
    j = low + np.arange(width)  # text places of row 0
    cost = np.where((j >= 0) & (j <= len(text)), 0, big).astype(np.int64)
    start = j.copy()
    ramp = np.arange(width)
    for i in range(1, len(item) + 1):
        j = i + low + ramp
        ok = (j >= 0) & (j <= len(text))
        ch = text[np.clip(j - 1, 0, max(0, len(text) - 1))] if len(text) else np.zeros(width, np.uint8)
        diagonal = cost + np.where((ch == item[i - 1]) & (j >= 1), 0, 1)
        up = np.append(cost[1:], big) + 1
        new = np.minimum(diagonal, up)
        src = np.where(diagonal <= up, start, np.append(start[1:], 0))
        new = np.where(ok, np.minimum(new, big), big)
        # Insertions run along the row: least of new[x] - x, plus x.
        shifted = new * width * 4 - ramp * width * 4 + ramp
        best = np.minimum.accumulate(shifted)
        pick = best % (width * 4)
        run = new[pick] + ramp - pick
        better = run < new
        cost = np.where(ok, np.minimum(np.where(better, run, new), big), big)
        start = np.where(better, src[pick], src)
    x = int(np.argmin(cost))
    return (int(cost[x]), int(start[x]), int(len(item) + low + x)) if cost[x] <= most else None


class Index:
    def __init__(self, items: list[tuple[int | None, str | None]]):
        known = [(i, normalised(t)) for i, t in items]
        self.items = [(i, np.frombuffer(t, np.uint8)) for i, t in known if len(t) > Q]
        size = [len(t) for _, t in self.items]
        self.edits = [min(int(m * EDITS), (m - Q) // Q) for m in size]
        self.least = [m + 1 - Q * (k + 1) for m, k in zip(size, self.edits)]
        code = [_codes(t) for _, t in self.items]
        c = np.concatenate([*code, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(code)), [len(x) for x in code])
        place = np.concatenate([*(np.arange(len(x)) for x in code), np.zeros(0, np.int64)])
        o = np.argsort(c, kind="stable")
        self.code, first, self.count = np.unique(c[o], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[o].astype(np.int64), place[o].astype(np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slot(self.code)] = True
        # Classes of items by length: (longest stretch, fewest q-grams of it).
        classes: dict[int, tuple[int, int]] = {}
        for m, k, t in zip(size, self.edits, self.least):
            a, b = classes.get(m.bit_length() * 4 + (m >> max(0, m.bit_length() - 3)) % 4, (0, 1 << 60))
            classes[m.bit_length() * 4 + (m >> max(0, m.bit_length() - 3)) % 4] = (max(a, m + k - Q + 1), min(b, t))
        self.classes = sorted(classes.values())

    def suspects(self, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents with a stretch that may hold an item."""
        hit = self.bits[_slot(c)]
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        seen = np.zeros(len(c) + 1, bool)
        for span, least in self.classes:
            span = min(span, len(c))
            seen[: len(c) - span + 1] |= sums[span:] - sums[: len(sums) - span] >= least
        # Stretches that cross into the next document only make more suspects; the tail of a block counts as one.
        far = np.concatenate([[0], np.cumsum(seen, dtype=np.int64)])
        longest = max(s for s, _ in self.classes)
        lo = np.clip(offsets[:-1] - longest, 0, len(seen))
        return np.flatnonzero(far[np.clip(offsets[1:], 0, len(seen))] - far[lo])

    def find(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) in normalised bytes."""
        c = _codes(text)
        at = np.flatnonzero(self.bits[_slot(c)])
        pos = np.searchsorted(self.code, c[at])
        ok = (pos < len(self.code)) & (self.code[np.minimum(pos, len(self.code) - 1)] == c[at])
        at, pos = at[ok], pos[ok]
        n = self.count[pos]
        total = int(n.sum())
        if not total:
            return []
        src = np.repeat(self.first[pos] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        item, diagonal = self.item[src], np.repeat(at, n) - self.place[src]
        out = []
        o = np.lexsort((diagonal, item))
        item, diagonal = item[o], diagonal[o]
        cuts = np.flatnonzero(np.diff(item)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)]):
            x = int(item[lo])
            least, k, (_, pattern) = self.least[x], self.edits[x], self.items[x]
            if hi - lo < least:
                continue
            step = max(16, k)
            d = diagonal[lo:hi]
            band = d // step
            b, cnt = np.unique(band, return_counts=True)
            both = cnt.copy()
            both[:-1] += np.where(b[1:] == b[:-1] + 1, cnt[1:], 0)
            good = [int(y) for y in b[both >= least]]
            best = None
            for y in good:
                low, high = y * step, (y + 2) * step - 1
                f, t = max(0, low - k), min(len(text), high + len(pattern) + k + 1)
                exact = text[f:t].tobytes().find(pattern.tobytes())
                m = (0, exact, exact + len(pattern)) if exact >= 0 else banded_edits(pattern, text[f:t], low - f, high - f, k)
                if m and (best is None or (m[0], m[1] + f) < best[:2]):
                    best = (m[0], m[1] + f, m[2] + f)
                if best and not best[0]:
                    break
            if best:
                out.append((x, *best))
        return out


def _matches(index: Index):
    def run(block) -> Iterator[tuple[int, list]]:
        data, offsets = block
        x, off, at = normalise(data, offsets)
        c = _codes(x)
        if not len(c) or not index.items:
            return
        for d in index.suspects(c, off):
            text = x[off[d] : off[d + 1]]
            if found := index.find(text):
                where = np.append(at[off[d] : off[d + 1]], offsets[d + 1]) - offsets[d]
                yield int(d), [(i, e, int(where[s]), int(where[t])) for i, e, s, t in found]

    return run


def _report(index: Index):
    look = _matches(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, _, data, offsets in utf8_blocks(pc.utf8_lower(b.column("t"))):
                for d, found in look((data, offsets)):
                    rows += [i + d] * len(found)
                    out += [(index.items[x][0], e, s, t) for x, e, s, t in found]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "item_id", "edits", "start", "end"]
            )

    return run


def _drop(index: Index):
    look = _matches(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, _, data, offsets in utf8_blocks(pc.utf8_lower(b.column("t"))):
                for d, _found in look((data, offsets)):
                    clean[i + d] = False
            yield b.filter(pa.array(clean))

    return run


def indexes(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """The benchmark in blocks of about ``limit`` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + int(total // limit)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Index(sorted(((r.i, r.t) for r in part.collect()), key=repr))


def find(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end): bytes of the lower-cased text, end exclusive; a row for each item in each document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("t"))
    out = None
    for index in indexes(benchmark, limit):
        part = rows.mapInArrow(_report(index), extend(rows.select("doc_id").schema, "item_id long, edits long, start long, end long"))
        out = part if out is None else out.unionByName(part)
    return out


query = find


def clean_documents(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    rows = docs.select(F.struct("*").alias("__doc"), F.col("text").cast("string").alias("t"))
    for index in indexes(benchmark, limit):
        rows = rows.mapInArrow(_drop(index), rows.schema)
    return rows.select("__doc.*")
