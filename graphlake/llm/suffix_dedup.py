"""Removal of byte strings that a document with a smaller id holds as well, by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of smaller ``doc_id``; strings are
judged on the input.  Four passes:

0. *Load.*  Anchors are counted by cell (leading bits of their hash), over all documents.  The number of buckets follows the
   bytes of text.  A cell with more contexts than a bucket should hold is hot: its anchors are made longer, by half of
   what strings have beyond them, on the left for strings that have so much there and on the right for the others.  A cell of
   longer anchors that is hot still has its contexts spread over all buckets.
1. *Anchors.*  The anchor of a string is its leftmost least ``Q``-byte substring by hash: equal strings have equal
   anchors at equal offsets, so strings need comparing only by anchor.  Strings in a row that share an
   anchor make a *context*.  Contexts (hashes only, 14 bytes and a document number) meet by anchor.  Equal contexts are one:
   the least document stands for it and all others lose theirs, first within a map task's ``FLUSH`` bytes of text
   and then in the bucket, which streams and is reduced as it grows.  Of what is left, contexts go on that share, by 12 bits
   of hash, a side of their anchor with another document: without that they have no string in common (of a hot cell of
   longer anchors: all).
2. *Suffix arrays.*  Those contexts' bytes meet by anchor.  Parts without any string that another context
   has too are left out (by hash), equal parts count once, and suffix arrays over the parts (linear grouping
   construction, ``gsaca.py``) tell which strings are equal: neighbours with a common prefix of ``LENGTH``.
   An anchor of more than ``CHUNK`` bytes, or of a hot cell, or whose parts exceed ``BLOCK``, has several suffix arrays; each
   decides all but the least holder of a string, and those meet once more, as strings of bytes, grouped by Spark.
3. *Removal.*  Intervals go back to their documents.

Equality of *whole* contexts and parts is that of hashes (87 bits and more): copies are collapsed before suffix arrays are made.

Documents travel once, by ``doc_id`` and 16 bits of the text's hash; both later passes read that shuffle, next to what is to be
known of them.  Bounds: a task holds the contexts of one bucket (``BUCKET`` bytes on average, hot cells spread), ``CHUNK`` bytes
of contexts spelled out, a suffix array of about ``BLOCK`` bytes; at most ``HOT`` cells are told to tasks.

Nulls and edges: null text is empty; matches never cross documents; a null ``doc_id`` neither loses bytes nor
costs others any; rows that share a ``doc_id`` don't cost each other any; texts under ``LENGTH`` bytes stay.
Removal works on bytes, so the rest of a document need not be valid UTF-8; it is kept as bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power, mix, prefix_sums, span_hashes, utf8_blocks
from .gsaca import lcp_array, suffix_array

LENGTH = 50
Q = 16
BLOCK = 1 << 16
CHUNK = 1 << 20
BUCKET = 8 << 20
FLUSH = 8 << 20
HOT = 1 << 20
#: Bytes of a context on its way to its bucket; a context stands for about 18 bytes of text.
ROW = 24
_SLOT = np.uint64(0xFFFF)
_POS = np.uint64((1 << 21) - 1)
#: Marks hashes of anchors made longer; hashes of sides are 12 bits.
_FINE, _SIDE = np.uint64(1 << 39), np.uint64(4095)
_M40, _M48 = np.uint64((1 << 40) - 1), np.uint64((1 << 48) - 1)


def _found(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Iterator[tuple]:
    """By piece: where it begins, its prefix sums; its contexts' anchor's hash, anchor, first and last string start, in the piece."""
    step = 1 << 20
    starts = range(0, max(1, len(data) - length + 1), step)
    ends_of = np.repeat(offsets[1:], np.diff(offsets))
    for lo in starts:  # one piece, but for documents of more than 2**20 bytes
        piece = data[lo : lo + step + length - 1]
        n = len(piece)
        if n < length:
            continue
        sums = prefix_sums(piece)
        m, w, nw = n - q + 1, length - q + 1, n - length + 1
        h = mix((sums[q:] - sums[:-q]) * _power("down", n + 1)[:m])
        k = (h & ~_POS) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            k = np.minimum(k[:-span], k[span:])
            span *= 2
        if w > span:
            k = np.minimum(k[: len(k) - (w - span)], k[w - span :])
        ok = np.flatnonzero(ends_of[lo : lo + nw] - np.arange(lo, lo + nw) >= length)
        if not len(ok):
            continue
        a = (k[ok] & _POS).astype(np.int64)
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        f = np.flatnonzero(first)
        yield lo, sums, h[a[f]] & ~_FINE, a[f], ok[f], ok[np.append(f[1:], len(a)) - 1]


def _sides(sums: np.ndarray, p: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The last start of strings with half of their other bytes before the anchor [p, p + w); hashes of these bytes and, for the
    strings that start later, of those they all have behind it (0: there is no such string). Equal strings agree in theirs."""
    border = p - (length - w + 1) // 2
    left = np.where(s <= border, span_hashes(sums, np.maximum(border, 0), p) | np.uint64(1), np.uint64(0))
    right = np.where(e > border, span_hashes(sums, p + w, np.minimum(border + 1 + length, len(sums) - 1)) | np.uint64(1), np.uint64(0))
    return border, left, right


def _fine(h: np.ndarray, side: np.ndarray, salt: int) -> np.ndarray:
    """The hash of an anchor made longer on one side."""
    return mix((h & _M40) * np.uint64(7) ^ side, salt) | _FINE


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int = Q, spread: Spread | None = None) -> tuple[np.ndarray, ...]:
    """Contexts: anchor's hash, anchor, first and last string start, context's hash, index of the document, hashes of its sides.

    Contexts of the spread's hot cells come as two, of longer anchors: of the strings with much before the anchor, and of the others."""
    none = np.zeros(0, np.int64)
    found = []
    for lo, sums, h, at, s, e in _found(data, offsets, length, q):
        p, w = at, np.full(len(at), q)
        hot = spread.is_hot(h) if spread else np.zeros(0, bool)
        if hot.any():
            border, left, right = _sides(sums, p, w, s, e, length)
            c, l, r = np.flatnonzero(~hot), np.flatnonzero(hot & (left > 0)), np.flatnonzero(hot & (right > 0))
            h = np.concatenate([h[c], _fine(h[l], left[l], 21), _fine(h[r], right[r], 23)])
            p = np.concatenate([at[c], border[l], at[r]])
            w = np.concatenate([w[c], at[l] + q - border[l], border[r] + 1 + length - at[r]])
            s, e = np.concatenate([s[c], s[l], np.maximum(s[r], border[r] + 1)]), np.concatenate([e[c], np.minimum(e[l], border[l]), e[r]])
            at = np.concatenate([at[c], at[l], at[r]])
        ck = span_hashes(sums, s, e + length) + (at - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        _, left, right = _sides(sums, p, w, s, e, length)
        side = (left % _SIDE + (left > 0)) | ((right % _SIDE + (right > 0)) << np.uint64(12))
        found.append((h, at + lo, s + lo, e + lo, mix(ck), side.astype(np.uint32)))
    if not found:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint32)
    *out, side = (np.concatenate(x) for x in zip(*found))
    return (*out, np.searchsorted(offsets, out[2], "right") - 1, side)


def _key(h: np.ndarray, ck: np.ndarray) -> np.ndarray:
    """An anchor and context in 63 bits; the lowest bit is free."""
    return mix((h & _M40) * np.uint64(3) ^ (ck & _M48), 5) & ~np.uint64(1)


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}I", *(a.nbytes for a in arrays))
    return b"".join([head, *(a.tobytes() for a in arrays)])


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}I", blob)
    at, out = 4 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, np.uint8 if kind == "raw" else kind, size if kind == "raw" else size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _low(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].ravel()


def _high(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = x.reshape(-1, n)
    return out.ravel().view("<u8")


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = b.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null(), bool)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(bucket, kind="stable")
    b = bucket[o]
    cut = np.flatnonzero(np.diff(b)) + 1
    for part in np.split(o, cut):
        if len(part):
            yield int(bucket[part[0]]), part


@dataclass(frozen=True)
class Spread:
    """Which bucket a context belongs to: that of its anchor's cell, or of anchor and context where the cell is hot.

    Anchors of hot cells are made longer, and longer anchors have cells of their own."""

    buckets: int
    bits: int
    hot: np.ndarray

    def cells(self, h: np.ndarray) -> np.ndarray:
        return (h & _M40) >> np.uint64(40 - self.bits)

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(h), bool)
        c = self.cells(h)
        return self.hot[np.minimum(np.searchsorted(self.hot, c), len(self.hot) - 1)] == c

    def of(self, h: np.ndarray, ck: np.ndarray) -> np.ndarray:
        x = mix(self.cells(h), 17)
        if len(self.hot):
            x = np.where(self.is_hot(h), mix((h & _M40) * np.uint64(5) ^ (ck & _M48), 19), x)
        return (x % np.uint64(self.buckets)).astype(np.int64)


def _cells(spread: Spread, length: int):
    """Documents to (cell, n): contexts by cell, of anchors as they are and made longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for _, _, data, offsets in utf8_blocks(b.column("text")):
                for _, sums, h, at, s, e in _found(data, offsets, length, Q):
                    _, left, right = _sides(sums, at, np.full(len(at), Q), s, e, length)
                    every = [h, _fine(h, left, 21)[left > 0], _fine(h, right, 23)[right > 0]]
                    n = np.bincount(spread.cells(np.concatenate(every)).astype(np.int64))
                    if len(n) > len(total):
                        total, n = n, total
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    return run


def spread_of(docs: DataFrame, length: int, bucket: int) -> Spread:
    """The layout for these documents; hot cells hold more than a bucket and one in ``HOT`` of all contexts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size * ROW // 18 // bucket
    even = Spread(buckets, min(40, 4 + int(buckets).bit_length()), np.zeros(0, np.uint64))
    cells = docs.mapInArrow(_cells(even, length), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    top = cells.where(F.col("n") > max(bucket // ROW, size // 18 // HOT)).select("cell").toArrow().column("cell")
    return Spread(even.buckets, even.bits, np.sort(np.asarray(top.to_numpy(), np.int64)).view(np.uint64))


def _reduced(h: np.ndarray, ck: np.ndarray, doc: np.ndarray, slot: np.ndarray, side: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct contexts of their least document, in the order of anchor and context, and those that others lose."""
    o = np.lexsort((slot, doc, ck, h))
    h, ck, doc, slot = h[o], ck[o], doc[o], slot[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ck[1:] != ck[:-1])
    more = np.zeros(len(h), bool)
    more[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (slot[1:] == slot[:-1])
    gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else new
    stay, lost = ~gone & ~more, gone & ~more
    return (h[stay], ck[stay], doc[stay], slot[stay], side[o[stay]]), (h[lost], ck[lost], doc[lost], slot[lost])


def _blob(h: np.ndarray, ck: np.ndarray, doc: np.ndarray, slot: np.ndarray, side: np.ndarray) -> bytes:
    """Documents are written once: most contexts of a blob share theirs with others."""
    o = np.lexsort((slot, doc))
    new = np.ones(len(o), bool)
    new[1:] = (doc[o[1:]] != doc[o[:-1]]) | (slot[o[1:]] != slot[o[:-1]])
    own = o[new]
    small = np.empty(len(o), np.int64)
    small[o] = np.cumsum(new) - 1
    return _pack(doc[own], slot[own].astype("<u2"), small.astype("<u2" if len(own) <= 1 << 16 else "<u4"), _low(h, 5), _low(ck, 6), _low(side, 3))


def _read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    ids, slots, small, h, ck, side = _unpack(blob, "<i8", "<u2", "raw", "raw", "raw", "raw")
    small = small.view("<u2" if len(ids) <= 1 << 16 else "<u4")
    return _high(h, 5), _high(ck, 6), ids[small], slots[small], _high(side, 3).astype(np.uint32)


def _contexts(spread: Spread, length: int, flush: int = FLUSH):
    """Documents to blobs of contexts by bucket; buckets under 0 hold keys of contexts that are gone already."""

    def packed(held, turn):
        (h, ck, doc, slot, side), lost = _reduced(*(np.concatenate(x) for x in zip(*held)))
        rows = [(k, _blob(h[at], ck[at], doc[at], slot[at], side[at])) for k, at in _split(spread.of(h, ck))]
        if len(lost[0]):
            rows.append((-1 - turn % spread.buckets, _pack(lost[2], lost[3].astype("<u2"), _key(lost[0], lost[1]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for b in batches:
            ids, null = _ids(b)
            slots = b.column("slot").to_numpy(zero_copy_only=False).astype(np.uint16)
            for i, j, data, offsets in utf8_blocks(b.column("text")):
                h, _, _, _, ck, d, side = anchors(data, offsets, length, spread=spread)
                d = d + i
                use = ~null[d]
                held.append((h[use] & _M40, ck[use] & _M48, ids[d[use]], slots[d[use]], side[use]))
                turn += int(offsets[-1]) + j - i
                size += len(data)
                if size > flush:
                    yield packed(held, turn)
                    held, size = [], 0
        if held:
            yield packed(held, turn)

    return run


def _several(doc: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Whether rows are of a run, by the other arrays, of more than one document."""
    if not len(doc):
        return np.zeros(0, bool)
    new = np.ones(len(doc), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in by], axis=0)
    f = np.flatnonzero(new)
    return (np.minimum.reduceat(doc, f) != np.maximum.reduceat(doc, f))[np.cumsum(new) - 1]


def _judge(spread: Spread, limit: int = 2 * BUCKET):
    """Contexts of a bucket to (doc_id, slot, key), bit 0 of the key set where bytes are wanted."""

    def told(h, ck, doc, slot, want=0):
        return _told(doc, slot, _key(h, ck) | np.uint64(want))

    def _told(doc, slot, key):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(slot.astype(np.int32)), pa.array(key.view(np.int64))], ["doc_id", "slot", "key"])

    def finish(held):
        if not held:
            return
        (h, ck, doc, slot, side), lost = _reduced(*(np.concatenate(x) for x in zip(*held)))
        if len(lost[0]):
            yield told(*lost)
        if not len(h):
            return
        several = _several(doc, h)
        w = np.flatnonzero(several)
        alike = np.zeros(len(w), bool)
        for x in (side[w] & 4095, side[w] >> 12):
            o = np.lexsort((x, h[w]))
            alike[o] |= _several(doc[w[o]], h[w[o]], x[o]) & (x[o] > 0)
        several[w] = alike
        several |= spread.is_hot(h)
        if several.any():
            yield told(h[several], ck[several], doc[several], slot[several], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, top = None, [], 0, limit
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                blob = blob.as_py()
                if k < 0:
                    yield _told(*_unpack(blob, "<i8", "<u2", "<u8"))
                    continue
                if k != now:
                    yield from finish(held)
                    now, held, size, top = k, [], 0, limit
                held.append(_read_blob(blob))
                size += len(held[-1][0]) * ROW
                if size > top:
                    kept, lost = _reduced(*(np.concatenate(x) for x in zip(*held)))
                    if len(lost[0]):
                        yield told(*lost)
                    held, size = [kept], len(kept[0]) * ROW
                    top = limit + 2 * size
        yield from finish(held)

    return run


def _listed(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists in rows [i, j) and each value's row, from i."""
    part = column.slice(i, j - i)
    n = np.asarray(pc.fill_null(pc.list_value_length(part), 0), np.int64)
    return part.flatten(), np.repeat(np.arange(j - i), n)


_CUTS = ["doc_id", "rk", "start", "end"]


def _intervals(doc: np.ndarray, rk: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 0: what goes from which row of the documents; intervals that touch are one."""
    o = np.lexsort((start, rk, doc))
    doc, rk, start, end = doc[o], rk[o], start[o], end[o]
    if len(o):
        # Within a row all are at most `length` + Q long and sorted, so only the one before can reach this one.
        top = np.maximum.accumulate(end + np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1]))) * (1 << 40)) % (1 << 40)
        new = np.ones(len(o), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1]) | (start[1:] > top[:-1])
        f = np.flatnonzero(new)
        doc, rk, start, end = doc[f], rk[f], start[f], top[np.append(f[1:], len(o)) - 1]
    n = len(doc)
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), none, pa.array(doc), pa.array(rk.view(np.int64)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["kind", "blob", *_CUTS])


def _rows(ids: np.ndarray, slots: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of the documents by 48 bits of id and text, and its slot."""
    th = span_hashes(prefix_sums(data), offsets[:-1], offsets[1:])
    return (mix(ids.view(np.uint64) ^ th, 11) & ~_SLOT) | slots.astype(np.uint64)


def _fetch(spread: Spread, length: int, flush: int = FLUSH // 2):
    """Documents with their keys to intervals (kind 0) and contexts' bytes (kind 1: blob, bucket in doc_id), ``flush`` bytes at a time."""

    def packed(held):
        bucket, h, doc, rk, s, rel, ln, raw = (np.concatenate(x) for x in zip(*held))
        begin = np.concatenate([[0], np.cumsum(ln)[:-1]])
        rows = [(k, _pack(h[x], doc[x], rk[x], s[x].astype(np.uint32), rel[x].astype(np.uint8), ln[x].astype(np.uint8), _gather(raw, begin[x], ln[x]))) for k, x in _split(bucket)]
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int64()), none, none, none], ["kind", "blob", *_CUTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids, null = _ids(b)
            slots = b.column("slot").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in utf8_blocks(b.column("text")):
                told, row = _listed(b.column("keys"), i, j)
                if not len(told):
                    continue
                k = np.asarray(told, np.int64).view(np.uint64)
                salt = mix(np.arange(j - i, dtype=np.uint64), 3) & ~np.uint64(1)
                keys = np.unique(((k & ~np.uint64(1)) + salt[row]) | (k & np.uint64(1)))
                h, at, s, e, ck, d, _ = anchors(data, offsets, length, spread=spread)
                if not len(h):
                    continue
                key = _key(h, ck) + salt[d]
                hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)]
                status = np.where((hit & ~np.uint64(1)) == key, 1 + (hit & np.uint64(1)).astype(np.int64), 0)
                status[null[d + i]] = 0
                if not status.any():
                    continue
                rk = _rows(ids[i:j], slots[i:j], data, offsets)
                base = offsets[:-1]
                doc = ids[i:j]
                w = np.flatnonzero(status == 1)
                if len(w):
                    yield _intervals(doc[d[w]], rk[d[w]], s[w] - base[d[w]], e[w] + length - base[d[w]])
                w = np.flatnonzero(status == 2)
                if len(w):
                    ln = e[w] + length - s[w]
                    held.append((spread.of(h[w], ck[w]), h[w], doc[d[w]], rk[d[w]], s[w] - base[d[w]], at[w] - s[w], ln, _gather(data, s[w], ln)))
                    size += int(ln.sum())
                    if size > flush:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return run


def _gather(data: np.ndarray, begin: np.ndarray, ln: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin - np.concatenate([[0], np.cumsum(ln)[:-1]]), ln) + np.arange(ln.sum())]


def least_holders(parts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string start of each part, the least owner of a part that holds an equal string, by a suffix array."""
    text: list[int] = []
    begin = []
    for p in parts:
        begin.append(len(text))
        text.extend([b + 2 for b in p])
        text.append(1)
    sa = suffix_array(text)
    lcp = np.array(lcp_array(text, sa))
    n = len(text)
    owner, counts = np.full(n, -1), np.zeros(n, bool)
    for b, p, o in zip(begin, parts, owners):
        owner[b : b + len(p) - length + 1] = o
        counts[b : b + len(p) - length + 1] = True
    order = np.array(sa)
    run = np.cumsum(lcp < length)
    top = np.iinfo(np.int64).max
    value = np.where(counts[order], owner[order], top)
    least = np.full(run[-1] + 1, top)
    np.minimum.at(least, run, value)
    out = np.empty(n, np.int64)
    out[order] = least[run]
    return [out[b : b + len(p) - length + 1] for b, p in zip(begin, parts)]


@dataclass
class _Parts:
    """Contexts spelled out: of whole anchors, or (``open``) of an anchor that other groups hold contexts of as well."""

    h: np.ndarray
    doc: np.ndarray
    rk: np.ndarray
    s: np.ndarray
    rel: np.ndarray
    ln: np.ndarray
    raw: np.ndarray
    open: bool

    def solve(self, length: int, block: int) -> Iterator[pa.RecordBatch]:
        h, doc, rk, s, rel, ln, raw = self.h, self.doc, self.rk, self.s, self.rel, self.ln, self.raw
        begin = np.concatenate([[0], np.cumsum(ln)[:-1]])
        sums = prefix_sums(raw)
        if self.open:
            c, k = np.arange(len(h)), np.zeros(len(h), np.int64)
            a, z = begin, begin + ln
        else:
            c, k, a, z = self._shared(begin, sums, length)
        if not len(c):
            return
        # Equal parts: the least document stands for them, all others lose theirs whole.
        ph = mix(span_hashes(sums, a, z) ^ mix(h[c] + (rel[c] - k).astype(np.uint64), 13))
        o = np.lexsort((doc[c], ph, h[c]))
        ph, c, a, z, k0 = ph[o], c[o], a[o], z[o], k[o]
        newp = np.ones(len(o), bool)
        newp[1:] = (ph[1:] != ph[:-1]) | (h[c[1:]] != h[c[:-1]])
        fp = np.flatnonzero(newp)
        of = np.cumsum(newp) - 1
        holder = doc[c]
        lead = holder[fp][of]
        cut: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, from, to (in the context)
        w = np.flatnonzero(holder > lead)
        cut.append((c[w], k0[w], k0[w] + z[w] - a[w]))
        # Different parts, anchor by anchor, in suffix arrays of about a block.
        hp = h[c[fp]]
        newh = np.ones(len(fp), bool)
        newh[1:] = hp[1:] != hp[:-1]
        first = np.searchsorted(of, np.arange(len(fp) + 1))
        size = z[fp] - a[fp]
        for p, opened in self._arrays(np.split(np.arange(len(fp)), np.flatnonzero(newh)[1:]), size, block):
            least = least_holders([raw[a[fp[x]] : z[fp[x]]].tobytes() for x in p], holder[fp[p]], length)
            strings = []
            for x, m in zip(p, least):
                mine = holder[fp[x]]
                gone = np.concatenate([[0], (m < mine).view(np.int8), [0]])
                e = np.flatnonzero(np.diff(gone))
                lo, hi = e[::2], e[1::2]
                for row in range(first[x], first[x + 1]):  # rows of one document come first and share its part
                    if holder[row] != mine:
                        break
                    if len(lo):
                        cut.append((np.full(len(lo), c[row]), k0[row] + lo, k0[row] + hi - 1 + length))
                    if opened:
                        strings.append((row, np.flatnonzero(m == mine)))
            if strings:
                row = np.repeat([r for r, _ in strings], [len(i) for _, i in strings])
                i = np.concatenate([i for _, i in strings])
                y, g, f = c[row], a[row] + i, s[c[row]] + k0[row] + i
                some = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(i), [None, pa.py_buffer(raw[g[:, None] + np.arange(length)].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(i), np.int32)), some.cast(pa.binary()), pa.array(doc[y]), pa.array(rk[y].view(np.int64)), pa.array(f), pa.array(f + length)], ["kind", "blob", *_CUTS])
        row, lo, hi = (np.concatenate(x) for x in zip(*cut))
        if len(row):
            yield _intervals(doc[row], rk[row], s[row] + lo, s[row] + hi)

    def _shared(self, begin: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Context, offset in it, begin and end of the parts whose strings documents other than their own hold as well."""
        nw = self.ln - length + 1
        ctx = np.repeat(np.arange(len(self.h)), nw)
        k = np.arange(nw.sum()) - np.repeat(np.concatenate([[0], np.cumsum(nw)[:-1]]), nw)
        at = begin[ctx] + k
        wh = span_hashes(sums, at, at + length) ^ mix(self.h[ctx] + (self.rel[ctx] - k).astype(np.uint64), 9)
        o = np.lexsort((self.doc[ctx], wh))
        new = np.ones(len(o), bool)
        new[1:] = wh[o[1:]] != wh[o[:-1]]
        f = np.flatnonzero(new)
        d = self.doc[ctx][o]
        shared = np.zeros(len(wh), bool)
        shared[o] = (d[f] != d[np.append(f[1:], len(d)) - 1])[np.cumsum(new) - 1]
        same = ctx[1:] == ctx[:-1]
        first, last = shared.copy(), shared.copy()
        first[1:] &= ~(shared[:-1] & same)
        last[:-1] &= ~(shared[1:] & same)
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        return ctx[first], k[first], at[first], at[last] + length

    def _arrays(self, anchors_: list[np.ndarray], size: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, bool]]:
        """Parts that one suffix array takes, and whether their strings have to meet those of others still."""
        todo: list[np.ndarray] = []
        held = 0
        for m in anchors_:
            total = np.cumsum(size[m])
            if self.open or total[-1] > 4 * block:
                for part in np.split(m, np.flatnonzero(np.diff(total // block)) + 1):
                    yield part, True
                continue
            if len(m) < 2:
                continue
            todo.append(m)
            held += int(total[-1])
            if held > block:
                yield np.concatenate(todo), False
                todo, held = [], 0
        if todo:
            yield np.concatenate(todo), False


def _resolve(spread: Spread, length: int, block: int = BLOCK, chunk: int = CHUNK):
    """Contexts' bytes of a bucket to intervals (kind 0), or strings (kind 1) to meet those of other suffix arrays; intervals pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _sorted_out(batches):
            if isinstance(blobs, pa.RecordBatch):
                yield blobs
                continue
            parts = []
            for blob in blobs:
                h, doc, rk, s, rel, ln, raw = _unpack(blob, "<u8", "<i8", "<u8", "<u4", "u1", "u1", "raw")
                parts.append((h, doc, rk, s.astype(np.int64), rel.astype(np.int64), ln.astype(np.int64), raw))
            h, doc, rk, s, rel, ln, raw = (np.concatenate(x) for x in zip(*parts))
            del parts
            begin = np.concatenate([[0], np.cumsum(ln)[:-1]])
            o = np.argsort(h, kind="stable")
            new = np.ones(len(o), bool)
            new[1:] = h[o[1:]] != h[o[:-1]]
            hot = spread.is_hot(h)
            for x, opened in _chunks(o, np.flatnonzero(new), hot[o], ln[o], chunk):
                yield from _Parts(h[x], doc[x], rk[x], s[x], rel[x], ln[x], _gather(raw, begin[x], ln[x]), opened).solve(length, block)

    return run


def _chunks(o: np.ndarray, first: np.ndarray, hot: np.ndarray, ln: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Contexts in the order of anchors, in runs of about ``chunk`` bytes: whole anchors, or stretches of one that is larger or hot."""
    end = np.append(first[1:], len(o))
    sums = np.concatenate([[0], np.cumsum(ln)])
    start, open_at = None, 0
    for f, e in zip(first, end):
        size = sums[e] - sums[f]
        if hot[f] or size > chunk:
            if start is not None:
                yield o[start:f], False
                start = None
            for part in np.split(np.arange(f, e), np.flatnonzero(np.diff((sums[f + 1 : e + 1] - sums[f]) // chunk)) + 1):
                yield o[part], True
            continue
        if start is None:
            start, open_at = f, sums[f]
        if sums[e] - open_at > chunk:
            yield o[start:e], False
            start = None
    if start is not None:
        yield o[start : end[-1]], False


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | list[bytes]]:
    """Rows of kind 0 as they come, blobs of kind 1 by bucket (rows arrive in the order of kind and bucket)."""
    now, held = None, []
    for b in batches:
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        n = int(np.searchsorted(kind, 1))
        if n:
            yield b.slice(0, n)
        for k, blob in zip(b.column("doc_id").slice(n).to_pylist(), b.column("blob").slice(n).to_pylist()):
            if k != now:
                if held:
                    yield held
                now, held = k, []
            held.append(blob)
    if held:
        yield held


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in the order of string and document: all but the least document's become intervals."""
    string, least = None, None
    for b in batches:
        gone = b.column("kind").to_numpy(zero_copy_only=False) == 0
        blob, doc = b.column("blob").to_pylist(), b.column("doc_id").to_pylist()
        for x in np.flatnonzero(~gone):
            if blob[x] != string:
                string, least = blob[x], doc[x]
            gone[x] = doc[x] > least
        yield b.filter(pa.array(gone)).select(_CUTS)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their intervals to documents with what is left."""
    for b in batches:
        ids, null = _ids(b)
        slots = b.column("slot").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in utf8_blocks(b.column("text")):
            n = np.diff(offsets)
            mine = _rows(ids[i:j], slots[i:j], data, offsets).view(np.int64)
            told, row = _listed(b.column("cuts"), i, j)
            rk, f, t = (np.asarray(told.field(k), np.int64) for k in range(3)) if len(row) else (np.zeros(0, np.int64),) * 3
            use = (rk == mine[row]) & ~null[i:j][row]
            row, f, t = row[use], f[use], t[use]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, offsets[row] + f, 1)
            np.add.at(step, offsets[row] + t, -1)
            gone = np.cumsum(step[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            first = offsets[:-1][n > 0]
            edge[first] = gone[first]
            spans = np.concatenate([[0], np.cumsum(edge)])
            left = []
            for a, z in zip(offsets[:-1], offsets[1:]):
                left.append(data[a:z][~gone[a:z]].tobytes() if removed[z] > removed[a] else data[a:z].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _remove(batches):
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in b.column("kept").to_pylist()])
        yield pa.RecordBatch.from_arrays([*b.columns[:4], sha], [*b.schema.names[:4], "kept_sha256"])


def dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False, bucket: int = BUCKET, chunk: int = CHUNK, block: int = BLOCK, flush: int = FLUSH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes (digest: their SHA-256)."""
    if length < 2 * Q or length > 200:
        raise ValueError("length must be between 32 and 200")
    slot = F.xxhash64("text").bitwiseAND(0xFFFF).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("slot", slot)
    spread = spread_of(docs, length, bucket)
    met = docs.mapInArrow(_contexts(spread, length, flush), "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    row = ["doc_id", "slot"]
    keys = met.mapInArrow(_judge(spread, 2 * bucket), "doc_id long, slot int, key long").groupBy(*row).agg(F.collect_set("key").alias("keys"))
    cut = "kind int, blob binary, doc_id long, rk long, start long, end long"
    # Both joins find the documents in the same shuffle (Spark reuses the exchange).
    fetched = docs.join(keys.hint("merge"), row, "left").mapInArrow(_fetch(spread, length), cut)
    solved = fetched.repartition("kind", "doc_id").sortWithinPartitions("kind", "doc_id").mapInArrow(_resolve(spread, length, block, chunk), cut)
    own = F.when(F.col("blob").isNull(), F.xxhash64("doc_id", "rk")).otherwise(F.xxhash64("blob"))
    settled = solved.repartition(own).sortWithinPartitions("kind", "blob", "doc_id").mapInArrow(_settle, "doc_id long, rk long, start long, end long")
    cuts = settled.groupBy("doc_id", F.col("rk").bitwiseAND(0xFFFF).cast("int").alias("slot")).agg(F.collect_list(F.struct("rk", "start", "end")).alias("cuts"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, "
    whole = docs.join(cuts.hint("merge"), row, "left")
    return whole.mapInArrow(_digest if digest else _remove, out + ("kept_sha256 string" if digest else "kept binary"))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs, digest=True)


QUERY_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS g FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT r, p FROM w JOIN m ON w.g = m.g WHERE doc_id > least),
runs AS (
  SELECT r, min(p) AS a, max(p) + 50 AS z FROM (
    SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM (
      SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY r, k),
gaps AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t, z - a AS n FROM runs),
parts AS (
  SELECT d.r, d.doc_id, len(d.h) // 2 AS n_bytes, g.n, g.f, CASE WHEN g.r IS NULL THEN h ELSE substr(h, 2 * f + 1, 2 * (t - f)) END AS part
  FROM d LEFT JOIN gaps g ON g.r = d.r
  UNION ALL
  SELECT d.r, d.doc_id, len(d.h) // 2, NULL, e.z, substr(h, 2 * e.z + 1) FROM d JOIN (SELECT r, max(z) AS z FROM runs GROUP BY r) e ON e.r = d.r)
SELECT any_value(doc_id) AS doc_id, any_value(n_bytes)::BIGINT AS n_bytes, coalesce(sum(n), 0)::BIGINT AS n_removed, count(n) AS n_spans,
       sha256(unhex(string_agg(part, '' ORDER BY coalesce(f, 0)))) AS kept_sha256
FROM parts GROUP BY r
"""
