"""Helpers shared by the training-data operators.

Word semantics everywhere: a word is a maximal run of bytes other than
0x20 and 0x09-0x0D.  Those are ASCII, so splitting UTF-8 bytes equals
splitting code points.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Texts are hashed in slices of about this many bytes, whatever the batch size is.
SLICE_BYTES = 2 << 20
#: Words are hashed in pieces of this many bytes, so that a long text costs little besides itself.
PIECE_BYTES = 1 << 18
#: The bounds of an Arrow batch: rows, and bytes (a longer row is a batch of its own).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_LIBC = ctypes.CDLL(None)
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch to BATCHES, for good: what a Python worker holds follows them."""
    for key, most in BATCHES.items():
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where it is unset (tests, a single local JVM) a temporary folder is used.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varloom/{label}-{uuid.uuid4().hex}"
    bounded(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the files of frames that :func:`written` returned and nothing reads any more."""
    for df in frames:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what is written and done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def returned() -> None:
    """Gives a worker's freed memory back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about limit bytes of text."""
    col = batch.column(text)
    lengths = np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop
    returned()


def packed(docs: DataFrame) -> DataFrame:
    """(id, z) of (id, text), null texts as empty ones: texts for a shuffle, at two thirds of their size there."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, z binary")


def unpacked(col) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(z).decode() for z in col.to_pylist()], pa.large_string())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Tables:
    """Byte codes and powers, made when first needed in a worker."""

    codes: dict[bool, np.ndarray] = {}
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    punctuation = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
    powers: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def code(cls, lower: bool) -> np.ndarray:
        if lower not in cls.codes:
            ids = np.arange(256, dtype=_U)
            if lower:
                ids[65:91] = ids[97:123]
            cls.codes[lower] = mix((ids + _U(1)) * _MULT)
        return cls.codes[lower]

    @classmethod
    def power(cls) -> tuple[np.ndarray, np.ndarray]:
        """The multiplier to the 0, 1, ... PIECE_BYTES, and its inverses."""
        if cls.powers is None or len(cls.powers[0]) != PIECE_BYTES + 1:
            both = []
            for base in (_MULT, _INV):
                step = np.full(PIECE_BYTES + 1, base, _U)
                step[0] = 1
                both.append(np.cumprod(step))
            cls.powers = both[0], both[1]
        return cls.powers


def _raised(n: int) -> np.uint64:
    return _U(pow(int(_MULT), n, 1 << 64))


class Words:
    """The words of some rows: starts/ends into data, their hashes, and for row r words first[r]:first[r+1]."""

    def __init__(self, col: pa.Array, lower: bool, bare: bool = False):
        """bare: words are runs of letters, digits and bytes above ASCII, not what white space leaves."""
        with np.errstate(over="ignore"):
            col = col.fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            lo, hi = int(offsets[0]), int(offsets[-1])
            raw = col.buffers()[2]
            self.data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
            self.offsets = offsets - lo
            self._split((_Tables.punctuation if bare else _Tables.space))
            self.first = np.searchsorted(self.starts, self.offsets)
            self.hash = self.prefixes(lower)

    def _split(self, apart: np.ndarray) -> None:
        n, starts, ends, last = len(self.data), [], [], False
        rows = np.unique(self.offsets)
        for lo in range(0, n, PIECE_BYTES):
            inside = ~apart[self.data[lo : lo + PIECE_BYTES]]
            before = np.empty(len(inside), bool)
            before[0], before[1:] = last, inside[:-1]
            head = np.zeros(len(inside), bool)
            head[rows[slice(*np.searchsorted(rows, (lo, lo + len(inside))))] - lo] = True
            starts.append(lo + np.flatnonzero(inside & (~before | head)))
            ends.append(lo + np.flatnonzero(before & (~inside | head)))
            last = bool(inside[-1])
        if last:
            ends.append(np.array([n]))
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))

    def prefixes(self, lower: bool, size: int | None = None) -> np.ndarray:
        """A hash of every word, or of its first size bytes (of shorter words: of them all)."""
        ends = self.ends if size is None else np.minimum(self.ends, self.starts + size)
        out = np.zeros(len(self.starts), _U)
        if not len(out):
            return out
        up, down = _Tables.power()
        code = _Tables.code(lower)
        with np.errstate(over="ignore"):
            for lo in range(0, len(self.data), PIECE_BYTES):
                data = self.data[lo : lo + PIECE_BYTES]
                a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(self.starts, lo + len(data)))
                if a >= b:
                    continue
                total = np.zeros(len(data) + 1, _U)
                np.cumsum(code[data] * up[: len(data)], out=total[1:])
                begin = np.maximum(self.starts[a:b] - lo, 0)
                part = (total[np.minimum(ends[a:b] - lo, len(data))] - total[begin]) * down[begin]
                if self.starts[a] < lo:  # the word goes on from the piece before
                    part[0] *= _raised(lo - int(self.starts[a]))
                out[a:b] += part
            return mix(out + (ends - self.starts).astype(_U))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words by first word, and whether the k words are of one row."""
        n = len(self.hash)
        fits = np.zeros(n, bool)
        if n < k:
            return np.zeros(n, _U), fits
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        fits[:] = np.arange(n) + k <= row_end
        with np.errstate(over="ignore"):
            acc = np.zeros(n - k + 1, _U)
            for j in range(k):
                acc = (acc + self.hash[j : n - k + 1 + j]) * _MULT
                acc ^= acc >> _U(29)
            out = np.zeros(n, _U)
            out[: n - k + 1] = mix(acc)
        return out, fits

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ints(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed bigint."""
    return values.view(np.int64)
