"""What the operators of this subpackage share: words, hashes, cutting of lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space and U+0009 to U+000D everywhere here; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SEPARATOR_RE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20  # bytes hashed at a time, so that long texts need no more memory than their words
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd and 5 modulo 8: powers repeat as late as possible


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one of a local session that has none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later steps neither recompute it nor depend on executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Tables in the shared folder: unlike checkpoints they are compressed, have columns, and don't hand on a plan, whose
    planning time would double over the rounds of a loop. ``drop`` deletes those that nothing reads any more; the others go
    when the driver's Python ends, because the result is still to be read from them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths):04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._known = [*getattr(self, "_known", []), out]  # ids of objects are only unique while these live
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := self.paths.get(id(t))):
                delete(self.spark, path)

    def _end(self) -> None:
        try:
            delete(self.spark, self.base)
        except Exception:  # the session has ended before
            return


def free_name(taken, name: str = "_text") -> str:
    """``name``, with as many underscores behind it as make it none of ``taken``."""
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            made = []
            for base in (self.base, self.inverse):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = made
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


def _hash_block(raw: bytes, head: int | None = None) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    gap = np.ones(len(b) + 2, dtype=bool)
    gap[1:-1] = _SEPARATOR[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if head:
        starts = starts[ends - starts > head]
        ends = starts + head
    up, down = _BYTES.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b + _U(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def word_hashes(raw: bytes, head: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order; with ``head``, of the first bytes of each longer word."""
    if len(raw) <= _BLOCK:
        return _hash_block(raw, head)
    parts, at = [], 0
    while at < len(raw):
        found = _SEPARATOR_RE.search(raw, at + _BLOCK)
        end = found.start() if found else len(raw)
        parts.append(_hash_block(raw[at:end], head))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if k <= 8:
        out = np.full(n, _U(k))
        for j in range(k):
            out = out * _BASE + words[j : j + n]
            out ^= out >> _U(29)
        return mix(out)
    up, down = _WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


#: Ids that are broadcast at most (16 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def restrict(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``left_semi``) or isn't (``left_anti``) in ``keys``, materialised and unique.

    The keys are counted first: few enough go to every task, so that wide rows stay where they are; else both shuffle.
    """
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)


def attach(df: DataFrame, table: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """``df`` joined with a materialised ``table``, which goes to every task if it is counted to be small enough."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_IDS else table, on, how)


#: Rows and bytes of an Arrow batch on its way to Python, where the session has left Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded: Spark's default of 10,000 rows is any number of bytes of texts."""
    conf = df.sparkSession.conf
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if conf.get(rows) == "10000":
        conf.set(rows, str(BATCH_ROWS))
    if _size(conf.get(size)) > BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))
    return df


def _size(text: str) -> int:
    digits = re.match(r"\d*", text)[0]
    return int(digits or 0) << {"k": 10, "m": 20, "g": 30}.get(text[len(digits) : len(digits) + 1].lower(), 0)


def trim() -> None:
    """Gives memory that a task has freed back to the machine, since workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        return


def bytes_of(column) -> list[bytes]:
    """An Arrow column of strings as UTF-8, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def ragged(parts: list[np.ndarray], kind=np.int64):
    """An Arrow list array of NumPy arrays."""
    import pyarrow as pa

    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def pieces(batches, budget: int = 1 << 20):
    """Arrow batches cut to slices whose first text column has about ``budget`` bytes, so that output stays small."""
    for batch in batches:
        n = batch.num_rows
        if n:
            each = max(1, int(n * budget / max(1, batch.nbytes)))
            for at in range(0, n, each):
                yield batch.slice(at, each)
    trim()
