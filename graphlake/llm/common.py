"""Shared plumbing: the shared folder, materialised tables and Arrow batches seen as numpy bytes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.store import settle as materialise
from ..sources.store import shared_dir

__all__ = ["materialise", "shared_dir"]
#: Bytes of text that numpy code looks at in one go; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch, to which its last row is added: Spark's own bound is 10,000 rows, however long their texts.
BATCH_BYTES = 1 << 22
#: Lets an execution remove its shuffle files when it ends; else they lie until the driver happens to collect its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="graphlake-ship-")) / "graphlake.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(at))


def bound_batches(spark: SparkSession) -> None:
    """Let batches that this session sends to Python end at ``BATCH_BYTES``, as an executor holds several for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise_lean(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, and the shuffle files of ``df`` are gone once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(REMOVE_SHUFFLES, None)
    conf.set(REMOVE_SHUFFLES, "true")
    try:
        return materialise(df, name)
    finally:
        if before is None:
            conf.unset(REMOVE_SHUFFLES)
        else:
            conf.set(REMOVE_SHUFFLES, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def extend(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def utf8_blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` for runs of rows of about ``limit`` bytes (null: empty)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _lut(inside) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for b in range(256) if inside(b)]] = True
    return out


SPACE = _lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_SPACE = ~SPACE
#: letters, digits and everything beyond ASCII
ALNUM = _lut(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 4096), _BASE if kind == "up" else _INV, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits are equally good."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * base**position, from which any substring's hash follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal strings get equal hashes wherever they stand."""
    inverse = _power("down", len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``inside`` that don't cross documents: starts, ends, index of the document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    s[first] = m[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the index of each first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:m].copy()
    for i in range(1, n):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : m + i]
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[at]), at
