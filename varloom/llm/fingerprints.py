"""Document fingerprints: winnowing of rolling k-gram hashes.

Every k consecutive code points have a rolling hash; of every ``window``
consecutive hashes the smallest is kept, the rightmost where several are
smallest, with its position.  Any passage of at least ``window + k - 1`` code
points that two texts share therefore leaves a common hash in both.

:func:`fingerprint` is the operator on one table; :func:`with_next` pairs each
row with the next one by id without a global window: rows are dealt to
contiguous id ranges, and the first row of a range is also sent, marked, to the
range before it, so that a range is self-contained.

Defined results: a null text counts as empty and has an empty fingerprint; a
text shorter than k is one gram; equal ids are ordered by text; a null id comes
first; a table of one row is its own neighbour; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import _INV, _MULT, _U, load, mix

K = 16
WINDOW = 32
#: Texts are hashed in overlapping pieces of this many code points, to bound memory.
PIECE = 1 << 18

_powers: dict[int, np.ndarray] = {}


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams."""
    n = len(codes)
    if _powers.get(0) is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_MULT, _INV)):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[i] = np.cumprod(step)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((codes.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93) * _powers[0][:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * _powers[1][: n - k + 1]) >> _U(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(kept 32-bit hashes, their positions), by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(codes))
    kept = []
    step = PIECE
    for begin in range(0, max(1, len(codes) - k - window + 2), step):
        part = codes[begin : begin + step + k + window - 2]
        hashes = _grams(part, k)
        # The smallest key has the smallest hash and, of equal ones, the largest position.
        keys = (hashes << _U(32)) | (_U(0xFFFFFFFF) - np.arange(len(hashes), dtype=_U))
        width, span = min(window, len(keys)), 1
        while span < width:
            shift = min(span, width - span)
            keys = np.minimum(keys[:-shift], keys[shift:])
            span += shift
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        kept.append(np.stack((keys >> _U(32), _U(0xFFFFFFFF) - (keys & _U(0xFFFFFFFF)) + _U(begin))))
    both = np.concatenate(kept, axis=1)
    both = both[:, np.concatenate(([True], both[1, 1:] != both[1, :-1]))]
    return both[0].astype(np.uint32), both[1].astype(np.int64)


def digest(hashes: np.ndarray) -> str:
    """The fingerprint as text: eight hex digits for each kept hash, by position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' distinct hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, hashes array<long>, positions array<long>, fingerprint) for every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [winnow(t or "", k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.tolist() for h, _ in found], pa.list_(pa.int64())), pa.array([p.tolist() for _, p in found], pa.list_(pa.int64())), pa.array([digest(h) for h, _ in found], pa.string())],
                names=[id_col, "hashes", "positions", "fingerprint"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, hashes array<bigint>, positions array<bigint>, fingerprint string")


def with_next(docs: DataFrame, pair, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pair(id, text, next text) -> tuple of schema, for each row and the next by id (the first follows the last)."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # n - 1 cut points and n first ids: bounded by the number of partitions.
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket_of(col: pa.Array) -> np.ndarray:
        ids = col.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return np.searchsorted(cuts, ids, side="right")

    def bucketed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0)).astype(np.int32)), batch.column(0)], names=["bucket", "id"])

    least = F.min(F.coalesce("id", F.lit(np.iinfo(np.int64).min)))
    firsts = sorted(rows.select("id").mapInArrow(bucketed, "bucket int, id bigint").groupBy("bucket").agg(least.alias("id")).collect())
    before = {first["id"]: firsts[i - 1]["bucket"] for i, first in enumerate(firsts)}

    def dealt(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_pylist()
            extra = [i for i, v in enumerate(ids) if v in before]
            order = pa.array([*range(len(ids)), *extra], pa.int64())
            buckets = [*bucket_of(batch.column(0)).tolist(), *(before[ids[i]] for i in extra)]
            tail = [False] * len(ids) + [True] * len(extra)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(tail), batch.column(0).take(order), batch.column(1).take(order)], names=["bucket", "tail", "id", "text"])

    ordered = rows.mapInArrow(dealt, "bucket int, tail boolean, id bigint, text string").repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema)).types

    def paired(batches):
        held = None
        for batch in batches:
            out = []
            for bucket, tail, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == bucket:
                    out.append(pair(held[1], held[2], text))
                held = None if tail else (bucket, id_, text)
                if tail:
                    # Further marked rows of this bucket are equal ids; the row before them has its neighbour.
                    continue
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    return ordered.mapInArrow(paired, schema)


def op3_fingerprints(spark, sf_dir):
    cache: dict[str, tuple] = {}

    def kept(text):
        if text not in cache:
            cache.clear()
            cache[text] = winnow(text)[0]
        return cache[text]

    def pair(doc_id, text, following):
        own = kept(text)
        cut = len(text) - len(text) // 4
        edited = text[:cut] + following[: len(text) // 4]
        changed = own if edited == text else winnow(edited)[0]
        after = kept(following)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(own), digest(changed), likeness(own, changed), likeness(own, after))

    return with_next(load(spark, sf_dir, "documents"), pair, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
