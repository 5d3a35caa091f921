"""Substring dedup: difference-cover anchors, then exact windows.

A window is ``size`` consecutive words of one document; a word goes if a window
over it also starts in a document with a smaller id.

The cover {0, 1, 3} modulo 7 holds every difference modulo 7.  So for any two
positions some shift below 7 takes both to cover positions, and two equal runs of
13 words share an anchor: 7 words that start at a cover position of both.

1. *Anchors.*  Documents are dealt by a hash of their id to chunks of bounded
   size; a chunk sends the hashes of its distinct anchors, 3 of 7 positions.
2. *Shared anchors.*  Anchors are dealt by hash; each chunk is told which of its
   anchors other chunks have too.
3. *Extension.*  Only windows around a shared anchor are extended to their full
   length; a chunk sends their 64-bit hashes, each with its least id there.
4. *Removal.*  Each chunk is told which of its windows start in a document with a
   smaller id elsewhere, adds those that do so within itself, and drops the words.

A passage that many documents share is one entry for a chunk, whatever the number
of its copies there, so no task gets more than one entry for each chunk and window;
parts are as many as the text is long.  Nothing but two sums reaches the driver.

Defined results: null and empty texts have no words; fewer than ``size`` words are
kept whole; equal ids do not remove each other's words; a null id counts as larger
than any; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import _U, Words, load, packed, tidy, unpacked, written

SIZE = 13
#: A perfect difference set: every difference modulo 7 is one of two members.
PERIOD, COVER = 7, (0, 1, 3)
CHUNK_BYTES = 4 << 20
PART_BYTES = 32 << 20

_LAST = np.iinfo(np.int64).max
_SHIFT = _U(16)  # anchors are compared by 48 bits: a filter, the windows by 64


class _Chunk:
    """The rows of a chunk by rising id, and their words."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks().fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order))
        self.ids = ids[order]
        self.out_ids = table.column("id").combine_chunks()
        self.words = Words(unpacked(table.column("z")), lower=False)
        self.rows = self.words.rows()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words.windows(size)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(48-bit hash, whether it is an anchor) by word."""
        hashes, fits = self.words.windows(size - PERIOD + 1)
        place = (np.arange(len(hashes)) - self.words.first[self.rows]) % PERIOD
        long = np.diff(self.words.first)[self.rows] >= size
        return hashes >> _SHIFT, fits & long & np.isin(place, COVER)


def _blobs(keys: np.ndarray, parts: int, *columns: np.ndarray):
    """(part, slice of every column) for sorted-by-part entries."""
    part = (keys % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
    begin = 0
    for end in ends.tolist():
        chosen = order[begin:end]
        yield int(part[chosen[0]]), [c[chosen] for c in columns]
        begin = end


def _six(v: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(_U)


def _table(names: str, types: list, rows: list) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names.split())


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _candidates(chunk: _Chunk, told: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, which of them hold an anchor that another row has too)."""
    anchors, is_anchor = chunk.anchors(size)
    own = np.flatnonzero(is_anchor)
    shared = np.zeros(len(anchors), bool)
    if len(own):
        order = own[np.argsort(anchors[own], kind="stable")]
        a, r = anchors[order], chunk.rows[order]
        # Rows of a run of equal anchors rise; more than one row if the first and the last differ.
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        ends = np.concatenate((starts[1:], [len(a)]))
        several = r[ends - 1] != r[starts]
        shared[order] = np.repeat(several, ends - starts)
        shared[own] |= _member(told, anchors[own])
    near = np.concatenate(([0], np.cumsum(shared)))
    n = len(anchors)
    hashes, fits = chunk.windows(size)
    return hashes, fits & (near[np.minimum(np.arange(n) + PERIOD, n)] > near[:n])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_words, n_removed, kept, spans array<struct<first,n>>) for every row; kept joins words by a space."""
    if size <= PERIOD:
        raise ValueError(f"windows have to be longer than {PERIOD} words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks, parts = 1 + total // CHUNK_BYTES, 1 + total // PART_BYTES
    dealt = packed(rows).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(chunks)).cast("long")).groupBy("chunk")

    def send_anchors(key, table):
        anchors, is_anchor = _Chunk(table).anchors(size)
        found = np.unique(anchors[is_anchor])
        return _table("part chunk keys", [pa.int64(), pa.int64(), pa.binary()], [(part, key[0].as_py(), _six(k)) for part, (k,) in _blobs(found, parts, found)])

    def share_anchors(key, table):
        of = table.column("chunk").to_pylist()
        blobs = [_from_six(b) for b in table.column("keys").to_pylist()]
        keys, who = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.concatenate((k[1:] == k[:-1], [False]))
        several = order[same | np.concatenate(([False], same[:-1]))]
        return _table("chunk keys", [pa.int64(), pa.binary()], _by_sender(several, who, keys, of, _six))

    def send_windows(key, left, right):
        if not left.num_rows:
            return _table("part chunk keys ids", [pa.int64(), pa.int64(), pa.binary(), pa.binary()], [])
        chunk = _Chunk(left)
        told = np.sort(np.concatenate([_from_six(b) for b in right.column("keys").to_pylist()] or [np.zeros(0, _U)]))
        hashes, mask = _candidates(chunk, told, size)
        at = np.flatnonzero(mask)
        # Rows rise by id, so the first place of a hash has its least id here.
        keys, first = np.unique(hashes[at], return_index=True)
        ids = chunk.ids[chunk.rows[at[first]]]
        pack = zstandard.ZstdCompressor(level=1).compress
        return _table("part chunk keys ids", [pa.int64(), pa.int64(), pa.binary(), pa.binary()], [(part, key[0].as_py(), k.tobytes(), pack(i.tobytes())) for part, (k, i) in _blobs(keys, parts, keys, ids)])

    def judge_windows(key, table):
        unpack = zstandard.ZstdDecompressor().decompress
        of = table.column("chunk").to_pylist()
        blobs = [np.frombuffer(b, _U) for b in table.column("keys").to_pylist()]
        keys = np.concatenate(blobs)
        ids = np.concatenate([np.frombuffer(unpack(b), np.int64) for b in table.column("ids").to_pylist()])
        who = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(starts, append=len(order)))
        return _table("chunk keys", [pa.int64(), pa.binary()], _by_sender(np.flatnonzero(least < ids), who, keys, of, lambda k: k.tobytes()))

    def remove(key, left, right):
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))])
        if not left.num_rows:
            return schema.empty_table()
        chunk = _Chunk(left)
        words, rows_of = chunk.words, chunk.rows
        told = np.sort(np.concatenate([np.frombuffer(b, _U) for b in right.column("keys").to_pylist()] or [np.zeros(0, _U)]))
        hashes, fits = chunk.windows(size)
        at = np.flatnonzero(fits)
        _, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
        goes = at[(chunk.ids[rows_of[at]] > chunk.ids[rows_of[at[first[which]]]]) | _member(told, hashes[at])]
        n = len(hashes)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, goes, 1)
        np.add.at(change, goes + size, -1)
        gone = np.cumsum(change[:n]) > 0
        out = []
        for row in range(left.num_rows):
            a, b = int(words.first[row]), int(words.first[row + 1])
            part = gone[a:b]
            left_over = a + np.flatnonzero(~part)
            kept = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[left_over].tolist(), words.ends[left_over].tolist(), strict=True)).decode()
            edges = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).astype(np.int8)))
            out.append((chunk.out_ids[row].as_py(), b - a, int(part.sum()), kept, [{"first": int(s), "n": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)]))
        return _table("id n_words n_removed kept spans", schema.types, out)

    anchors = dealt.applyInArrow(send_anchors, "part bigint, chunk bigint, keys binary")
    shared = written(anchors.groupBy("part").applyInArrow(share_anchors, "chunk bigint, keys binary"), "substring-anchors")
    tidy(docs.sparkSession)
    windows = dealt.cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, "part bigint, chunk bigint, keys binary, ids binary")
    judged = written(windows.groupBy("part").applyInArrow(judge_windows, "chunk bigint, keys binary"), "substring-windows")
    tidy(docs.sparkSession)
    done = dealt.cogroup(judged.groupBy("chunk")).applyInArrow(remove, "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<first:bigint,n:bigint>>")
    return done.withColumnRenamed("id", id_col)


def _by_sender(chosen: np.ndarray, who: np.ndarray, keys: np.ndarray, of: list, pack) -> list[tuple]:
    """(chunk, packed keys) for each sender of chosen entries."""
    chosen = chosen[np.argsort(who[chosen], kind="stable")]
    ends = np.flatnonzero(np.diff(who[chosen], append=-1)) + 1
    out, begin = [], 0
    for end in ends.tolist():
        out.append((of[int(who[chosen[begin]])], pack(keys[chosen[begin:end]])))
        begin = end
    return out


def op4_substrings(spark, sf_dir):
    found = dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), x AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM x
), m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k
), g AS (SELECT DISTINCT h.doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (k) WHERE m.least < h.doc_id
), r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id
), a AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id
), t AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)
), z AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept FROM t ANTI JOIN g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT a.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM a LEFT JOIN z ON z.doc_id = a.doc_id
"""
