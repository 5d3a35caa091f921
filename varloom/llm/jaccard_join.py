"""N-gram Jaccard join: a token-group matrix over word shingles, exact at any size.

A text's set holds the 64-bit hashes of its distinct 5-word shingles.  Two texts
link when 100 * |x & y| >= 75 * |x | y|.  The result is the components of that
graph; no link between different sets is missed, and pairs within a group of
copies are never listed.

1. *Sets.*  One scan gives each row its set's size and signature; equal sets are
   one class.  It also counts shingles that are common in a slice.
2. *Prefixes.*  In one order of all shingles (rare before common, then by hash) the
   first ``n - ceil(0.75 n) + DEPTH`` of a set hold at least ``DEPTH`` shingles of any
   set it links with (all that both share, if fewer).  A slice sends each shingle of its
   prefixes once, in six bytes, and is told which ones other classes have too; classes
   with fewer than ``DEPTH`` of those have no partner and go no further.
3. *Groups.*  Classes are partitioned by the hub they share most prefix shingles
   with, a hub being the class of a shingle with the smallest share of rare
   shingles: the centre of a family of near copies.  Every class is verified against
   at most three hubs; what links is one component, at one check a member.
4. *Matrix.*  (shingle, group) rows hold each group's union of prefix shingles.  A
   class's overlap with a group's union bounds its overlap with any member, so
   only other groups with ``DEPTH`` shared shingles are opened.
5. *Own group.*  The method is applied again within a group, to what sets its members
   apart: a member is its difference to the group's centre c.  With L shingles of c
   lost, A added and w = 4 L + 3 A, x and y link when their differences share at least
   (w(x) + w(y) - |c|) / 7 shingles, x and c when w(x) <= |c|.  So members that
   miss the centre (strays) are partitioned again by hubs of their differences, round
   by round while that links any; what is left is bounded by the
   shingles of a difference that other members' differences have, and only
   prefixes of differences are joined.  A member that has little in common with the
   centre is a group by itself.
6. Pairs that are left, of different components, are verified on the whole sets.

The order of shingles only moves work about: which shingles count as common comes
from counts over all documents, and at most ``2 * COMMON`` of them are sent to the tasks.

Defined results: null and blank texts have an empty set and are linked with
nothing; fewer than five words are one shingle; a very long text is one set like any
other (its task holds some 20 bytes for each of its bytes); equal ids are rows of their own; a
null id never names a component, and such a row links through rows of an equal set
that have an id; ids are whole numbers (or castable to them); further columns are not
read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from varloom.llm.common import _U, Words, bounded, forget, ints, load, mix, returned, slices, tidy, unpacked, written

SHINGLE = 5
SIMILAR, OF = 75, 100
DEPTH = 6
COMMON = 1 << 16
#: A shingle in this many different sets of one slice counts towards the common ones.
SEEN = 3
#: A shingle in this many prefixes is common too.
MANY = 8
#: Strays meet hubs again as long as this share of them finds a link.
ROUND_SHARE = 0.05
#: A member with w over so many times its centre's size has little in common with it, and is a group by itself.
FAR = 5
#: Centres with w up to so many times the other's size make one family.
NEAR = 4
#: Prefix shingles are dealt to parts of about so many bytes of text.
PART_BYTES = 32 << 20
#: Shingles are compared by 48 bits where that only filters or orders.
_SHIFT = _U(16)


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    hashes, fits = words.windows(size)
    counts = np.diff(words.first)
    out = []
    short: dict[int, np.ndarray] = {}
    for row, n in enumerate(counts.tolist()):
        a = int(words.first[row])
        if n >= size:
            out.append(np.unique(hashes[a : a + n - size + 1]))
        elif n:
            if n not in short:
                short[n] = words.windows(n)[0]
            out.append(short[n][a : a + 1])
        else:
            out.append(np.zeros(0, _U))
    return out


def _signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The signature of every set of tokens, the sets standing one after another."""
    out, some = np.zeros(len(sizes), _U), sizes > 0
    begin = (np.cumsum(sizes) - sizes)[some]
    if len(begin):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(tokens, begin) ^ (np.bitwise_xor.reduceat(tokens, begin) * _U(0x9E3779B97F4A7C15)) ^ sizes[some].astype(_U))
    return out


_PROFILES = "ids array<bigint>, signs array<bigint>, sizes array<bigint>, seen array<bigint>, times array<bigint>"
_PREFIXES = "slice bigint, own binary, sizes binary, rare binary, counts binary, tokens binary"
_LONGS = pa.list_(pa.int64())


def _distinct(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(signatures, sizes of the texts' sets; signatures, the sets, and a row of each distinct one that is not empty)."""
    sets = shingle_sets(Words(col, lower=True))
    sizes = np.array([len(s) for s in sets], np.int64)
    signs = _signatures(np.concatenate(sets), sizes)
    some = np.flatnonzero(sizes)
    own, first = np.unique(signs[some], return_index=True)
    return signs, sizes, own, [sets[i] for i in some[first]], some[first]


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.array([len(s) for s in sets], np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """A row for each slice: its rows' ids, signatures and sizes, and shingles that several of its sets have."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                signs, sizes, _, sets, _ = _distinct(part.column("text"))
                keys, times = np.unique(_joined(sets)[0] >> _SHIFT, return_counts=True)
                keys, times = keys[times >= SEEN], times[times >= SEEN]
                row = part.column("id").to_pylist(), ints(signs), sizes, ints(keys), times
                yield pa.RecordBatch.from_arrays([pa.array([v], _LONGS) for v in row], names=["ids", "signs", "sizes", "seen", "times"])

    return docs.select("id", "text").mapInArrow(run, _PROFILES)


class Order:
    """The order of shingles: those in keys (48 bits, by rising count) come last."""

    def __init__(self, common: np.ndarray):
        self.ranks = np.argsort(common).astype(np.int64)
        self.keys = common[self.ranks]
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.keys >> _U(28)).astype(np.int64)] = True

    def common(self, tokens: np.ndarray) -> np.ndarray:
        """The place in keys of each token, -1 for those that are not there."""
        out = np.full(len(tokens), -1, np.int64)
        maybe = np.flatnonzero(self.may[(tokens >> _U(44)).astype(np.int64)])
        if len(maybe):
            keys = tokens[maybe] >> _SHIFT
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == keys, at, -1)
        return out

    def prefixes(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefix shingles, set of each, share of shingles that are not common, in thousandths, by set)."""
        least = -(-SIMILAR * sizes // OF)
        want = sizes - least + np.minimum(DEPTH, least)
        place = self.common(tokens)
        rare = place < 0
        which = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], np.cumsum(rare)))
        n_rare = before[ends] - before[ends - sizes]
        rank = before[:-1] - np.repeat(before[ends - sizes], sizes)
        chosen = rare & (rank < want[which])
        kept, sets = [tokens[chosen]], [which[chosen]]
        for i in np.flatnonzero(n_rare < want).tolist():
            begin, end = int(ends[i] - sizes[i]), int(ends[i])
            at = begin + np.flatnonzero(~rare[begin:end])
            at = at[np.argsort(self.ranks[place[at]], kind="stable")][: int(want[i] - n_rare[i])]
            kept.append(tokens[at])
            sets.append(np.full(len(at), i))
        return np.concatenate(kept), np.concatenate(sets), 1000 * n_rare // np.maximum(sizes, 1)


def _six(v: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(_U)


def _prefixed(docs: DataFrame, order: Order) -> DataFrame:
    """A row for each slice: of its distinct sets the signature, size, share of rare shingles and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    kinds = [pa.int64(), *[pa.binary()] * 5]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, own, sets, _ = _distinct(part.column("text"))
                tokens, sizes = _joined(sets)
                prefix, which, rare = shared.value.prefixes(tokens, sizes)
                by_set = np.argsort(which, kind="stable")
                row = own, sizes.astype(np.int32), rare.astype(np.int16), np.bincount(which, minlength=len(own)).astype(np.int32), prefix[by_set]
                # The name is fixed once this is written, and only then used.
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((secrets.randbits(62), *(v.tobytes() for v in row)), kinds, strict=True)], names=["slice", "own", "sizes", "rare", "counts", "tokens"])

    return docs.select("text").mapInArrow(run, _PREFIXES)


def _dealt(keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places in keys of each part's keys."""
    part = (keys % _U(parts)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    return np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(keys) else []


def _shown(docs: DataFrame, order: Order, parts: int) -> DataFrame:
    """(part, keys, times): as _sent, without the slices and signatures, straight from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                prefix = shared.value.prefixes(*_joined(_distinct(part.column("text"))[3]))[0]
                keys, times = np.unique(prefix >> _SHIFT, return_counts=True)
                times = np.minimum(times, 255).astype(np.uint8)
                out = [(int(keys[at[0]] % _U(parts)), _six(keys[at]), times[at].tobytes()) for at in _dealt(keys, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "keys", "times"])

    return docs.select("text").mapInArrow(run, "part bigint, keys binary, times binary")


def _sent(prefixes: DataFrame, parts: int) -> DataFrame:
    """(part, slice, keys, times, signs): each slice's prefix shingles by 48 bits, dealt to parts, with how many sets have each (255: or more) and one that has it."""
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, first, times = np.unique(np.frombuffer(row["tokens"], _U) >> _SHIFT, return_index=True, return_counts=True)
                signs = np.repeat(np.frombuffer(row["own"], _U), np.frombuffer(row["counts"], np.int32))[first]
                times = np.minimum(times, 255).astype(np.uint8)
                out = [(int(keys[at[0]] % _U(parts)), row["slice"], _six(keys[at]), times[at].tobytes(), signs[at].tobytes()) for at in _dealt(keys, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["part", "slice", "keys", "times", "signs"])
            returned()

    return prefixes.select("slice", "own", "counts", "tokens").mapInArrow(run, "part bigint, slice bigint, keys binary, times binary, signs binary")


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of all keys, keys in order, begins of equal keys, sets that have each distinct key, equal sets of several slices counted again)."""
    keys = np.concatenate([_from_six(b) for b in table.column("keys").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    times = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("times").to_pylist()])[order].astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return order, keys, begins, np.add.reduceat(times, begins)


def _crowded(key, table):
    _, keys, begins, total = _gathered(table)
    top = np.argsort(-total, kind="stable")[:COMMON]
    top = top[total[top] >= MANY]
    return pa.table({"token": pa.array(ints(keys[begins[top]])), "c": pa.array(total[top])})


def _told(key, table):
    """(slice, keys): of the keys that a slice sent, those that more than one class has."""
    order, keys, begins, total = _gathered(table)
    lengths = np.diff(begins, append=len(keys))
    signs = np.concatenate([np.frombuffer(b, _U) for b in table.column("signs").to_pylist()])[order]
    several = (total > lengths) | (np.minimum.reduceat(signs, begins) != np.maximum.reduceat(signs, begins))
    who = np.repeat(np.arange(table.num_rows), [len(b) // 6 for b in table.column("keys").to_pylist()])[order]
    at = np.flatnonzero(np.repeat(several, lengths))
    at = at[np.argsort(who[at], kind="stable")]
    edges = np.flatnonzero(np.diff(who[at], prepend=-1, append=-1))
    slice_of = table.column("slice").to_pylist()
    out = [(slice_of[int(who[at[a]])], _six(keys[at[a:b]])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return pa.table({"slice": pa.array([o[0] for o in out], pa.int64()), "keys": pa.array([o[1] for o in out], pa.binary())})


_CLASSES = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("met", _LONGS)])


def _met(prefixes: DataFrame, told: DataFrame) -> DataFrame:
    """(sig, n, rare, met): the sets with enough prefix shingles that others have, and those shingles."""

    def run(key, left, right):
        out = []
        known = np.sort(np.concatenate([_from_six(b) for b in right.column("keys").to_pylist()] or [np.zeros(0, _U)]))
        for row in left.to_pylist() if len(known) else ():
            sizes, rare, counts = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["rare"], np.int16), np.frombuffer(row["counts"], np.int32)
            tokens, signs, which = np.frombuffer(row["tokens"], np.int64), np.frombuffer(row["own"], np.int64), np.repeat(np.arange(len(counts)), counts)
            keys = tokens.view(_U) >> _SHIFT
            hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
            tokens, count = tokens[hit], np.bincount(which[hit], minlength=len(counts))
            ends = np.cumsum(count)
            for i in np.flatnonzero(count >= np.minimum(DEPTH, -(-SIMILAR * sizes.astype(np.int64) // OF))).tolist():
                out.append((int(signs[i]), int(sizes[i]), int(rare[i]), tokens[ends[i] - count[i] : ends[i]]))
        return pa.table([pa.array([o[k] for o in out], f.type) for k, f in enumerate(_CLASSES)], schema=_CLASSES)

    return prefixes.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, "sig bigint, n int, rare int, met array<bigint>")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, n, z), a row for each class of wanted, z being its set; texts travel packed, a slice's equal sets once."""

    def signed(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, own, _, rows = _distinct(part.column("text"))
                texts = part.column("text").take(pa.array(rows, pa.int64())).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ints(own)), pa.array([pack(t.encode()) for t in texts], pa.binary())], names=["sig", "z"])

    def opened(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = shingle_sets(Words(unpacked(part.column("z")), lower=True))
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array([len(f) for f in found], pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], names=["sig", "n", "z"])
            returned()

    packed = docs.select("text").mapInArrow(signed, "sig bigint, z binary")
    return packed.join(wanted, "sig", "left_semi").dropDuplicates(["sig"]).mapInArrow(opened, "sig bigint, n int, z binary")


def _with_sets(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with za and zb, where the sizes allow a link; whole: (sig, n, z), a row for each class."""
    a, b = (whole.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("z").alias(f"z{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b")


def _linked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Of the (a, b) pairs of signatures, those whose sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                keep.append(OF * both >= SIMILAR * ((len(x) + len(y)) // 8 - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
            returned()

    return _with_sets(pairs, whole).filter(_close("na", "nb")).select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the least node reachable over (a, b) edges, for every node of an edge.

    Each round takes the least root among the neighbours, then the root's root;
    long chains take a number of rounds that grows with their length's logarithm at best.
    """
    both = written(edges.union(edges.select("b", "a")).distinct(), f"{label}-edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"), F.lit(True).alias("moved")), f"{label}-0")
    step = 0
    while True:
        step += 1
        roots = now.select("node", "root")
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        moved = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "seen").alias("mid"))
        jump = roots.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = written(moved.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") < F.col("before")).alias("moved")), f"{label}-{step}")
        forget(now)
        now = after
        if not after.filter("moved").take(1):
            forget(both)
            return after.select("node", "root")


def _close(a: str, b: str):
    """Whether the sizes alone allow a link."""
    return (F.col(a) * OF >= F.col(b) * SIMILAR) & (F.col(b) * OF >= F.col(a) * SIMILAR)


def _need(n, m):
    """How many prefix shingles linked sets of n and m shingles share at least."""
    least = F.ceil(F.greatest(n, m) * SIMILAR / OF)
    behind = least - F.least(F.lit(DEPTH), least)
    return F.greatest(F.least(F.lit(DEPTH), least), F.ceil((n + m) * SIMILAR / (OF + SIMILAR)) - behind)


def _enough(shared: DataFrame) -> DataFrame:
    """(a, b) of the (token, a, na, b, nb) rows that share as many prefix shingles as linked sets must.

    Up to where the first of two prefixes ends, what they do not share neither set
    shares; so the overlap is at most the shared ones and what lies behind the
    larger set's prefix, and has to be SIMILAR / (OF + SIMILAR) of both sizes.
    """
    counted = shared.groupBy("a", "b", _need(F.col("na"), F.col("nb")).alias("need")).agg(F.count(F.lit(1)).alias("shared")).filter("shared >= need")
    return counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _crossed(member: DataFrame) -> DataFrame:
    """member without shingles of one group."""
    crossed = member.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("token")
    return member.join(crossed, "token")


def _pruned(member: DataFrame) -> DataFrame:
    """member without classes that meet too few shingles of other groups, and then without shingles of one group."""
    bound = F.least(F.lit(DEPTH), F.ceil(F.first("n") * SIMILAR / OF))
    enough = member.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), bound.alias("bound")).filter("c >= bound").select("sig")
    return _crossed(member.join(enough, "sig"))


def _as(member: DataFrame, k: str, *more: str) -> DataFrame:
    return member.select("token", F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("grp").alias(f"g{k}"), *more)


def _across(member: DataFrame) -> DataFrame:
    """Candidate pairs of classes of different groups, by the token-group matrix."""
    union = member.groupBy("token", F.col("fam").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sized = (F.col("n") * OF >= F.col("low") * SIMILAR) & (F.col("high") * OF >= F.col("n") * SIMILAR)
    met = member.join(union, "token").filter("fam <> other").filter(sized).groupBy("sig", "n", "other").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    # What a pair has to share rises with the partner's size up to n and falls beyond it, but for
    # rounding: over a group's range of sizes it is least at an end.
    ends = (F.greatest(F.col("low"), F.ceil(F.col("n") * SIMILAR / OF)), F.least(F.col("high"), F.floor(F.col("n") * OF / SIMILAR)))
    bound = F.greatest(F.least(F.lit(DEPTH), F.ceil(F.col("n") * SIMILAR / OF)), F.least(*(_need(F.col("n"), m) for m in ends)) - 2)
    opened = met.filter(F.col("shared") >= bound).select(F.col("sig").alias("a"), F.col("other").alias("fam"))
    mine = _as(member, "a").join(opened, "a")
    return _enough(mine.join(_as(member, "b", "fam"), ["token", "fam"]).filter("ga <> gb").filter(_close("na", "nb")))


def _differences(placed: DataFrame, whole: DataFrame) -> DataFrame:
    """(fam, sig, grp, w, size, tokens) of (fam, sig, grp): the shingles that set a member apart from its family's centre, of size shingles; null where w is over FAR * size."""

    def run(batches):
        for batch in batches:
            tokens, weights = [], []
            for x, c in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                x, c = np.frombuffer(x, _U), np.frombuffer(c, _U)
                lost, added = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
                weights.append(4 * len(lost) + 3 * len(added))
                tokens.append(ints(np.concatenate((lost, added))) if weights[-1] <= FAR * len(c) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("b"), batch.column("a"), batch.column("grp"), pa.array(weights, pa.int64()), batch.column("nb"), pa.array(tokens, _LONGS)], names=["fam", "sig", "grp", "w", "size", "tokens"]
            )
            returned()

    pairs = _with_sets(placed.select(F.col("sig").alias("a"), F.col("fam").alias("b"), "grp"), whole)
    return pairs.select("b", "a", "grp", F.col("nb").cast("bigint").alias("nb"), "za", "zb").mapInArrow(run, "fam bigint, sig bigint, grp bigint, w bigint, size bigint, tokens array<bigint>")


def _alive(apart: DataFrame) -> DataFrame:
    """The (fam, token, sig, grp, w, size, stray) rows that can matter, with s, the shingles of a member that count, and partner.

    A shingle counts if members of two components have it, one of them a stray.  A
    pair needs (w(x) + w(y) - size) / 7 of them, no more than either's s, and x or y is a
    stray; so a member is held against the least w of every s in its family.
    partner is the least that it has to share with any stray, other that with any member;
    null without one.
    """
    several = apart.groupBy("fam", "token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("stray").alias("any"), F.count(F.lit(1)).alias("c")).filter("lo <> hi and any").select("fam", "token", "c")
    met = apart.join(several, ["fam", "token"])
    members = met.groupBy("fam", "sig").agg(F.first("w").alias("w"), F.first("size").alias("size"), F.first("stray").alias("stray"), F.count(F.lit(1)).alias("s"))
    # As many entries as there are values of s in a family: no more than its largest difference has shingles.
    least = members.groupBy("fam", "s").agg(F.min("w").alias("any"), F.min(F.when(F.col("stray"), F.col("w"))).alias("stray")).groupBy("fam").agg(F.collect_list(F.struct("s", "any", "stray")).alias("others"))

    def need(w):
        return F.greatest(F.lit(1), F.ceil((F.col("w") + w - F.col("size")) / 7))

    def possible(kind: str):
        return lambda e: e[kind].isNotNull() & (need(e[kind]) <= F.least("s", e["s"]))

    held = members.join(least, "fam").filter(F.when(F.col("stray"), F.exists("others", possible("any"))).otherwise(F.exists("others", possible("stray"))))
    partner = F.array_min(F.transform(F.filter("others", possible("stray")), lambda e: need(e["stray"])))
    other = F.array_min(F.transform(F.filter("others", possible("any")), lambda e: need(e["any"])))
    return met.join(held.select("fam", "sig", "s", partner.alias("partner"), other.alias("other")), ["fam", "sig"])


_APART = ("fam", "token", "sig", "grp", "w", "size", "stray")


def _regrouped(apart: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """apart with the components that links between its components make."""
    moved = components(links, label).select(F.col("node").alias("grp"), "root")
    return apart.join(moved, "grp", "left").withColumn("grp", F.coalesce("root", "grp")).select(*_APART)


def _centres(placed: DataFrame, met: DataFrame, whole: DataFrame) -> DataFrame:
    """(fam, centre): families whose centres are near one another become that of the largest; met: (sig, the family of each of its shingles' hubs)."""
    sizes = written(placed.groupBy("fam").agg(F.count(F.lit(1)).alias("members")), "jaccard-families")
    others = met.join(sizes.select(F.col("fam").alias("sig")), "sig", "left_semi").filter("sig <> to").groupBy("sig").agg(F.expr("mode(to, true)").alias("fam"))
    near = _differences(others.withColumn("grp", F.col("sig")), whole).filter(F.col("w") <= NEAR * F.col("size"))
    trees = components(near.select(F.col("sig").alias("a"), F.col("fam").alias("b")), "jaccard-centres")
    sized = trees.join(sizes, F.col("node") == F.col("fam"), "left").select("root", "node", F.coalesce("members", F.lit(0)).alias("members"))
    largest = sized.groupBy("root").agg(F.max_by("node", F.struct("members", "node")).alias("centre"))
    return trees.join(largest, "root").select(F.col("node").alias("fam"), "centre")


def _regular(member: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, in which those far from their family's centre are families of one; the others' differences)."""
    placed = member.select("sig", "grp", "fam").distinct()
    parts = placed.groupBy("fam").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("fam")
    differ = written(_differences(placed.join(parts, "fam"), whole), "jaccard-differences")
    far = differ.filter("tokens is null").select("sig", F.lit(True).alias("far"))
    moved = member.join(far, "sig", "left").withColumn("fam", F.when(F.col("far"), F.col("sig")).otherwise(F.col("fam"))).drop("far")
    return written(moved, "jaccard-regular"), differ


def _within(differ: DataFrame, whole: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(links found on the way, candidate pairs) of classes of one group and different components of it."""
    spark = differ.sparkSession
    near = differ.filter("tokens is not null")
    apart = near.withColumn("token", F.explode("tokens")).withColumn("stray", F.col("w") > F.col("size")).select(*_APART)
    # The centre's component bears its name, and what is no stray links with it.
    own = written(near.filter("w <= size and grp <> fam").select(F.col("sig").alias("a"), F.col("fam").alias("b"), "grp"), "jaccard-own")
    links = [own.select("a", "b")] if own.take(1) else []
    if links:
        apart = _regrouped(apart, own.select(F.col("grp").alias("a"), "b"), "jaccard-own-groups")
    whole_apart = written(apart, "jaccard-apart")
    apart = written(_alive(whole_apart).select(*_APART), "jaccard-alive")
    forget(whole_apart)
    tidy(spark)
    while True:
        # Strays meet the hub of their shingles: of those that have one, the least apart from the centre.
        hub = apart.filter("stray").groupBy("fam", "token").agg(F.min(F.struct("w", "sig", "grp")).alias("hub"))
        near = apart.join(hub, ["fam", "token"]).filter("grp <> hub.grp").select("sig", "grp", F.col("hub.sig").alias("b"), F.col("hub.grp").alias("to"))
        most = near.groupBy("sig", "b").agg(F.count(F.lit(1)).alias("c"), F.first("grp").alias("grp"), F.first("to").alias("to"))
        best = written(most.groupBy("sig").agg(F.max_by(F.struct("b", "grp", "to"), F.struct("c", "b")).alias("x")).select(F.col("sig").alias("a"), "x.*"), "jaccard-sub-hubs")
        found = written(_linked(best.select("a", "b"), whole), "jaccard-sub-links")
        tested, linked = best.count(), found.count()
        if linked:
            links.append(found)
            joined = found.join(best, ["a", "b"]).select(F.col("grp").alias("a"), F.col("to").alias("b"))
            before, apart = apart, written(_alive(_regrouped(apart, joined, "jaccard-sub-groups")).select(*_APART), "jaccard-alive")
            forget(before)
        tidy(spark)
        if linked < ROUND_SHARE * tested or not linked:
            break
    alive = written(_alive(apart), "jaccard-held")
    # In one order, rarest first, the first shingle that a pair shares is among the first
    # s - partner + 1 of the one and s - other + 1 of the stray.
    rank = F.row_number().over(Window.partitionBy("fam", "sig").orderBy("c", "token"))
    ranked = written(alive.withColumn("rank", rank), "jaccard-ranked")
    left = ranked.filter(F.col("rank") <= F.col("s") - F.col("partner") + 1).select("fam", "token", F.col("sig").alias("b"), F.col("grp").alias("gb"), F.col("w").alias("wb"), F.col("stray").alias("also"), (F.col("partner") - 1).alias("pb"), F.col("s").alias("sb"))
    right = ranked.filter("stray").filter(F.col("rank") <= F.col("s") - F.col("other") + 1).select("fam", "token", F.col("sig").alias("a"), F.col("grp").alias("ga"), F.col("w").alias("wa"), "size", (F.col("other") - 1).alias("pa"), F.col("s").alias("sa"))
    need = F.ceil((F.col("wa") + F.col("wb") - F.col("size")) / 7)
    met = left.join(right, ["fam", "token"]).filter("ga <> gb and (not also or b < a)").filter(need <= F.least("sa", "sb"))
    # What they share behind the first of the two ends is no more than what stands there.
    pairs = met.groupBy("a", "b", need.alias("need"), F.greatest("pa", "pb").alias("behind")).agg(F.count(F.lit(1)).alias("shared")).filter("shared + behind >= need")
    return links, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; component_id is the least id of its component."""
    profiles, rows, named = _classified(docs, id_col, text_col)
    full = rows.filter("n > 0").join(named, "sig").select("id", "n", "component")
    out = written(full.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component"))), "jaccard-result")
    forget(profiles, named)
    return out.toDF(id_col, "n_shingles", "component_id")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a table to be forgotten; (id, sig, n) for every row, read from it; (sig, root, component) for every class)."""
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = written(_profiles(texts), "jaccard-profiles")
    rows = profiles.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("signs").alias("sig"), F.col("sizes").alias("n"))).alias("x")).select("x.*")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    return profiles, rows, _class_components(texts, profiles, classes)


def _class_components(texts: DataFrame, profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, root, component) for every class: its component's name, and the least id there."""
    spark = classes.sparkSession
    counted = profiles.select(F.explode(F.arrays_zip(F.col("seen").alias("token"), F.col("times").alias("c"))).alias("x")).groupBy("x.token").agg(F.sum("x.c").alias("c"))

    def top(counts: DataFrame) -> np.ndarray:
        got = counts.orderBy(F.desc("c"), "token").limit(COMMON).collect()
        return np.array([r["token"] for r in reversed(got)], np.int64).view(_U)

    common = top(counted)
    # Eight bytes a shingle.
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = 1 + 8 * total // PART_BYTES
    # Shingles that many prefixes hold come late in the order, so the counts are taken twice:
    # with what slices have shown, and with what the first prefixes show.
    found = top(_shown(texts, Order(common), parts).groupBy("part").applyInArrow(_crowded, "token bigint, c bigint"))
    tidy(spark)
    prefixes = written(_prefixed(texts, Order(np.concatenate((found[~np.isin(found, common)], common)))), "jaccard-prefixes")
    told = _sent(prefixes, parts).groupBy("part").applyInArrow(_told, "slice bigint, keys binary")
    some = written(_met(prefixes, told), "jaccard-met")
    forget(prefixes)
    tidy(spark)

    # Of the classes that have a shingle the most central is its hub.
    shared = some.dropDuplicates(["sig"]).select(F.explode("met").alias("token"), "sig", "n", "rare")
    central = shared.groupBy("token").agg(F.min(F.struct("rare", "sig")).alias("hub"), F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("token", F.col("hub.sig").alias("hub"))
    matrix = written(shared.drop("rare").join(central, "token"), "jaccard-matrix")
    forget(some)
    tidy(spark)
    hubs = written(matrix.groupBy("sig").agg(F.expr("mode(hub, true)").alias("fam"), F.min_by("hub", "token").alias("h1"), F.max_by("hub", "token").alias("h2")), "jaccard-hubs")
    whole = written(_whole(texts, hubs.select("sig")), "jaccard-whole")
    tidy(spark)

    stars = hubs.select(F.col("sig").alias("a"), F.explode(F.array_distinct(F.array("fam", "h1", "h2"))).alias("b")).filter("a <> b")
    first = written(_linked(stars, whole), "jaccard-links")
    groups = components(first, "jaccard-groups")
    # Hubs of one component stand for one group.
    of_hub = groups.select(F.col("node").alias("fam"), F.col("root").alias("hub_root"))
    placed = hubs.select("sig", "fam").join(of_hub, "fam", "left").select("sig", F.coalesce("hub_root", "fam").alias("fam")).join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    centres = _centres(placed, matrix.join(of_hub.withColumnRenamed("fam", "hub"), "hub", "left").select("sig", F.coalesce("hub_root", "hub").alias("to")), whole)
    placed = placed.join(centres, "fam", "left").withColumn("fam", F.coalesce("centre", "fam")).drop("centre")
    member = matrix.select("token", "sig", "n").join(placed, "sig").select("token", "sig", "n", F.coalesce("root", "sig").alias("grp"), "fam")
    crossed = written(_crossed(member), "jaccard-crossed")
    forget(matrix, hubs)
    tidy(spark)
    member = written(_pruned(crossed), "jaccard-members")
    forget(crossed)
    tidy(spark)

    regular, differ = _regular(member, whole)
    forget(member)
    more, inner = _within(differ, whole)
    inner = written(inner, "jaccard-inner")
    forget(differ)
    tidy(spark)
    outer = written(_across(regular), "jaccard-outer")
    forget(regular)
    tidy(spark)
    second = written(_linked(outer.union(inner).distinct(), whole), "jaccard-more-links")
    tidy(spark)

    # Groups and what links them; a class outside every link is its own component.
    for found in (*more, second):
        first = first.union(found)
    roots = components(first, "jaccard-components").withColumnRenamed("node", "sig")
    rooted = classes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least_id = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    out = written(rooted.join(least_id, "root").select("sig", "root", "component"), "jaccard-named")
    forget(whole)
    return out


def op10_jaccard_join(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with one row of each component; rows without words stay, as they are linked with nothing.

    The row of the least id stays, a null id coming last.  Of rows with one id the one
    whose set has the least signature stays, and of rows with equal ids and sets any one.
    """
    profiles, rows, named = _classified(docs, "doc_id", "text")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig")).alias("x")
    best = rows.filter("n > 0").join(named, "sig").groupBy("root").agg(least).select("x.id", "x.sig")
    kept = written(best.union(rows.filter("n = 0").select("id", F.lit(0).cast("bigint"))), "jaccard-kept")
    repeated = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or id is null").select("id"), "jaccard-repeated")
    forget(profiles, named)
    id_ = docs["doc_id"].cast("long")
    if not repeated.take(1):
        return docs.join(kept.select(F.col("id").alias("__id")), id_ == F.col("__id"), "left_semi")
    once = kept.join(repeated, "id", "left_anti").select(F.col("id").alias("__id"))
    several = _signed(docs.join(repeated, id_.eqNullSafe(repeated["id"]), "left_semi"))
    wordless = several.filter(F.col(several.columns[-1]) == 0)
    sign = several.columns[-1]
    wanted = kept.select(F.col("id").alias("__id"), F.col("sig").alias("__kept"))
    chosen = several.filter(F.col(sign) != 0).join(wanted, several["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (several[sign] == wanted["__kept"]), "left_semi")
    return docs.join(once, id_ == F.col("__id"), "left_semi").unionByName(wordless.drop(sign)).unionByName(chosen.dropDuplicates(["doc_id", sign]).drop(sign))


def _signed(docs: DataFrame) -> DataFrame:
    """docs and, as a last column, the signature of the row's set; 0 for an empty one."""
    name = "sign"
    while name in docs.columns:
        name += "_"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part.column("text").cast(pa.large_string()), lower=True))
                signs = _signatures(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ints(signs))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
