"""Benchmark decontamination: pigeonhole edit matching over words.

A test item of m words may differ from a passage by up to
``k = floor(rate * m)`` word edits (insert, delete, replace).  Cut into k + 1
pieces, at least one piece is untouched in any such passage, so every exact
piece hit gives a place to verify with Myers' bit-parallel distance, the words
being the symbols.  Words are runs of letters, digits and characters above
ASCII, with A-Z lowered; case and punctuation make no difference.

Items are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words, read one
block at a time, so what is broadcast is bounded whatever the benchmark's size;
documents are scanned once per block and never shuffled.

Defined results: null or empty items and documents match nothing; items of
fewer than ``MIN_EDIT_WORDS`` words have to occur exactly; an item or a document that
is there twice gives its rows twice; empty tables give no row.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Words, load, slices

RATE = 0.15
MIN_EDIT_WORDS = 8
BLOCK_WORDS = 2_000_000


def distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Myers: (least distance of pattern to any stretch of text, the stretch's end)."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        at[symbol] = at.get(symbol, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = at.get(symbol, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~((eq | down) | rise)), rise & (eq | down)
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A block of items, ready for matching."""

    def __init__(self, ids: list, texts: list, rate: float):
        words = Words(pa.array(texts, pa.string()), lower=True, bare=True)
        self.ids, self.words, self.budget = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for row, item in enumerate(ids):
            own = words.hash[words.first[row] : words.first[row + 1]]
            m = len(own)
            if not m:
                continue
            k = math.floor(rate * m) if m >= MIN_EDIT_WORDS else 0
            cuts = [round(i * m / (k + 1)) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = Words.__new__(Words)
                part.hash, part.first = own[lo:hi], np.array([0, hi - lo])
                pieces.setdefault(hi - lo, []).append((int(part.windows(hi - lo)[0][0]), len(self.ids), lo))
            self.ids.append(item)
            self.words.append(own)
            self.budget.append(k)
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            self.pieces[size] = (np.array([f[0] for f in found], np.uint64), [f[1:] for f in found])

    def match(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words) for the best place of each item in each row."""
        places: dict[tuple[int, int], set[int]] = {}
        rows = words.rows()
        for size, (keys, where) in self.pieces.items():
            hashes, fits = words.windows(size)
            left = np.searchsorted(keys, hashes)
            hit = fits & (left < len(keys))
            hit[hit] = keys[left[hit]] == hashes[hit]
            for at in np.flatnonzero(hit):
                i = int(left[at])
                while i < len(keys) and keys[i] == hashes[at]:
                    item, offset = where[i]
                    places.setdefault((int(rows[at]), item), set()).add(int(at) - offset)
                    i += 1
        out = []
        for (row, item), starts in places.items():
            pattern, k = self.words[item], self.budget[item]
            m, lo, hi = len(pattern), int(words.first[row]), int(words.first[row + 1])
            best = None
            # Places that touch are verified as one stretch.
            stretches: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(lo, s - k), min(hi, s + m + k)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], b)
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                d, end = distance(pattern.tolist(), words.hash[a:b].tolist())
                if d <= k and (best is None or d < best[0]):
                    # The start, by the same distance from the end backwards.
                    back = distance(pattern[::-1].tolist(), words.hash[max(a, a + end - m - k) : a + end][::-1].tolist())[1]
                    best = (d, a + end - back - lo, back)
                    if d == 0:
                        break
            if best:
                out.append((row, item, *best))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[tuple[list, list]]:
    """The items in blocks of bounded size; the number of blocks follows from the table."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A word takes two characters at least.
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(total // (2 * block_words))
    if n == 1:
        got = [rows.orderBy("id", "text").collect()]
    else:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        got = (dealt.filter(F.col("block") == b).drop("block").orderBy("id", "text").collect() for b in range(n))
    return (([r["id"] for r in part], [r["text"] for r in part]) for part in got)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc id, item id, distance, first_word, n_words): a row for each document and item that occurs in it."""
    schema = f"{id_col} bigint, {item_id} bigint, distance int, first_word bigint, n_words int"
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))

    def scan(known) -> DataFrame:
        def run(batches):
            block = known.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = block.match(Words(part.column("text"), lower=True, bare=True))
                    if found:
                        row, item, dist, first, n = zip(*found)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(dist, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32())], names=[id_col, item_id, "distance", "first_word", "n_words"])

        return rows.mapInArrow(run, schema)

    sc = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [scan(sc.broadcast(Items(ids, texts, rate))) for ids, texts in blocks(items, item_id, item_text, block_words)])


def op2_decontaminate(spark, sf_dir):
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows in which an item occurs, whatever their ids; no row is shuffled."""
    sc = docs.sparkSession.sparkContext

    def without(rows: DataFrame, known) -> DataFrame:
        def run(batches):
            block = known.value
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[f[0] for f in block.match(Words(part.column(at).cast(pa.string()), lower=True, bare=True))]] = False
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    for ids, texts in blocks(items, "item_id", "text", block_words):
        docs = without(docs, sc.broadcast(Items(ids, texts, rate)))
    return docs
