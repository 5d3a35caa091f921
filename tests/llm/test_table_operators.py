"""Operators that compare rows of a table, and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varloom.llm import common, jaccard_join, mixing, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig long, token string, n int, kind string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """(id, text[, source]) rows, with further columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "t", 2, "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def some_text(rng, n, vocabulary=60):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


# --- 4 ---


def plain_dedup(rows, size):
    least = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            least[key] = min(least.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - size + 1):
            if least[tuple(w[j : j + size])] < (math.inf if i is None else i):
                gone |= set(range(j, j + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [200, 1 << 22])
def test_substrings_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "PART_BYTES", chunk * 3)
    rng = np.random.default_rng(0)
    passages = [some_text(rng, n) for n in (13, 14, 20, 60, 12)]
    rows = []
    for i in rng.permutation(70).tolist():
        t = some_text(rng, int(rng.integers(0, 40)))
        for p in rng.choice(len(passages), 2):
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + passages[p] + t[at:]
        rows.append((i, "  ".join(t) + "\n"))
    rows += [(90, None), (91, ""), (92, "a b c"), (93, " ".join(passages[3] * 2)), (94, rows[0][1]), (94, rows[0][1]), (None, rows[1][1]), (95, "x " * 4000), (96, "x " * 20)]
    got = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(docs(spark, rows)).collect()], key=str)
    assert got == plain_dedup(rows, 13)


def test_cover_holds_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_spans_are_what_is_removed(spark):
    a = " ".join(f"a{i}" for i in range(20))
    r = {x["doc_id"]: x for x in substrings.dedup(docs(spark, [(1, a), (2, f"p q {a} r")])).collect()}
    assert [(s["first"], s["n"]) for s in r[2]["spans"]] == [(2, 20)] and r[2]["kept"] == "p q r" and r[1]["spans"] == []
    assert substrings.dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="longer than"):
        substrings.dedup(docs(spark, []), size=7)


# --- 5 ---


def plain_mix(rows, budget, limit):
    """Targets by source, as the definition says."""
    tokens = Counter()
    for r in rows:
        tokens[r[2] or ""] += len(words(r[1]))
    tokens = {s: n for s, n in sorted(tokens.items()) if n}
    total = sum(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(mixing.STEPS):
        mid = (lo + hi) / 2
        raised = {s: (n / total) ** mid for s, n in tokens.items()}
        high = max(raised[s] / sum(raised.values()) * budget / n for s, n in tokens.items()) > limit
        lo, hi = (mid, hi) if high else (lo, mid)
    raised = {s: (n / total) ** hi for s, n in tokens.items()}
    return tokens, {s: math.floor(raised[s] / sum(raised.values()) * budget) for s in tokens}


def test_mix_meets_targets_and_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(some_text(rng, int(rng.integers(1, 30)))), ["big", "mid", "tiny"][min(2, int(rng.exponential(0.7)))]) for i in range(900)]
    rows += [(2000, None, "mid"), (2001, "", None), (2002, "a b", None), (2003, "x " * 3000, "big"), (2004, "", "hollow")]
    budget = sum(len(words(r[1])) for r in rows)
    got = mixing.mix(docs(spark, rows), block_rows=50, keep=("doc_id", "lang", "block")).toPandas()
    tokens, target = plain_mix(rows, budget, mixing.REPEAT_LIMIT)
    longest = {s: max(len(words(r[1])) for r in rows if (r[2] or "") == s) for s in tokens}
    for s in tokens:
        part = got[got.source == s]
        assert target[s] - longest[s] <= part.n_tokens.sum() <= target[s]
        full = target[s] // tokens[s]
        for e in range(1, full + 1):
            assert sorted(part[part.epoch == e].doc_id) == sorted(r[0] for r in rows if (r[2] or "") == s)
        assert part.epoch.max() <= full + 1 and target[s] / tokens[s] <= mixing.REPEAT_LIMIT + 1e-6
        assert not part.duplicated(["doc_id", "epoch"]).any()
    assert "hollow" not in set(got.source)
    assert mixing.mix(docs(spark, [])).count() == 0
    even = mixing.mix(docs(spark, rows), target_entropy=math.log(len(tokens)) - 1e-4, block_rows=50).groupBy("source").agg(F.sum("n_tokens").alias("n")).toPandas()
    assert even.n.min() > 0.5 * even.n.max()


def test_exponents_on_both_sides_of_one(spark):
    totals = spark.createDataFrame([("big", 900), ("small", 100)], "source string, tokens long")

    def entropy(target):
        got = mixing.exponents(totals, F.lit(1000), None, target).collect()
        return got[0]["exponent"], -sum(r["weight"] * math.log(r["weight"]) for r in got if r["weight"])

    for target in (0.1, 0.3, 0.5, 0.69):
        exponent, found = entropy(target)
        assert abs(found - target) < 1e-9 and (exponent > 1) == (target < 0.325)
    assert entropy(0.0)[0] == mixing.STEEPEST and entropy(1.0)[0] < 1e-9
    capped = mixing.exponents(totals, F.lit(10_000), 4.0, None).collect()
    assert {r["source"]: r["target"] for r in capped} == {"big": 3600, "small": 400}


def test_epochs_are_permuted_anew(spark):
    rows = [(i, "a b c", "s") for i in range(40)]
    got = mixing.mix(docs(spark, rows), budget_tokens=360, block_rows=5).toPandas()
    orders = [tuple(got[got.epoch == e].drop_duplicates("block").sort_values("block_order").block) for e in (1, 2, 3)]
    assert len(set(orders)) == 3 and len({frozenset(o) for o in orders}) == 1


# --- 10 ---


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), math.inf), i)
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, first, n, length, edits):
    base = some_text(rng, length, 400)
    out = [(first, " ".join(base))]
    for i in range(1, n):
        t = list(base)
        for at in rng.choice(length, int(rng.integers(0, edits)), replace=False):
            t[at] = f"e{rng.integers(0, 10**6)}"
        out.append((first + i, " ".join(t)))
    return out


def worn_copies(rng, first, n, length, edits, spots):
    """Copies of one text that lose, replace and repeat words at few places, and copies of a far copy."""
    base = some_text(rng, length, 10**6)
    far = list(base)
    for at in range(0, length, 9):
        far[at] = f"f{at}"
    out = []
    for i in range(n):
        t = list(far if i % 3 == 0 else base)
        for at in sorted(rng.choice(length, int(rng.integers(0, edits)), replace=True).tolist(), reverse=True):
            at = at % spots if rng.random() < 0.7 else at
            kind = rng.integers(0, 3)
            t[at : at + 1] = [] if kind == 0 else [f"x{rng.integers(0, 3)}"] if kind == 1 else t[max(0, at - 6) : at + 1]
        out.append((first + i, " ".join(t)))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_join_within_one_family_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "SEEN", 2)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 20_000)
    monkeypatch.setattr(common, "SLICE_BYTES", 5_000)
    rng = np.random.default_rng(seed)
    rows = worn_copies(rng, 0, 150, 90, 9, 90) + worn_copies(rng, 200, 90, 60, 7, 20) + worn_copies(rng, 400, 60, 25, 4, 25)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect())
    assert got == plain_components(rows)


def test_least_shared_prefix_shingles_are_least_at_an_end(spark):
    """What _across asks of a group is no more than what any partner of its range of sizes has to share."""
    top = 160
    sizes = spark.range(1, top).select(F.col("id").alias("n")).crossJoin(spark.range(1, top).select(F.col("id").alias("m"))).filter(jaccard_join._close("n", "m"))
    need = {(r["n"], r["m"]): r["need"] for r in sizes.select("n", "m", jaccard_join._need(F.col("n"), F.col("m")).alias("need")).collect()}
    for n in range(1, top):
        for low in range(-(-75 * n // 100), n * 100 // 75 + 1):
            if low >= top:
                break
            least = need[n, low]
            for high in range(low, min(top - 1, n * 100 // 75) + 1):
                least = min(least, need[n, high])
                assert max(min(6, -(-75 * n // 100)), min(need[n, low], need[n, high]) - 2) <= least


def test_linked_sets_share_prefix_shingles():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        pool = rng.integers(0, 2**63, 200).astype(np.uint64)
        order = jaccard_join.Order(rng.permutation(np.unique(pool[: int(rng.integers(0, 150))] >> np.uint64(16))))
        x = np.unique(rng.choice(pool, n))
        y = np.unique(np.concatenate((rng.choice(x, len(x) - len(x) // 12, replace=False), rng.choice(pool, len(x) // 12))))
        tokens, which, _ = order.prefixes(np.concatenate((x, y)), np.array([len(x), len(y)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert len(np.intersect1d(tokens[which == 0], tokens[which == 1])) >= min(jaccard_join.DEPTH, both)


def test_one_row_of_each_component_stays(spark):
    a, b = "a b c d e f g", "p q r s t u v w"
    rows = [(3, a), (3, a), (4, a), (None, b), (None, b), (None, a), (9, "x y z"), (9, b), (None, None), (None, None), (7, ""), (7, "")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.clean(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (9, b), (9, "x y z"), (None, None), (None, None), (7, ""), (7, "")], key=str)
    assert jaccard_join.clean(docs(spark, rows)).columns == docs(spark, rows).columns
    rows = [(None, b), (None, b), (1, a)]
    assert sorted((r["text"] for r in jaccard_join.clean(docs(spark, rows)).collect())) == [a, b]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SEEN", 2)
    rng = np.random.default_rng(2)
    rows = near_copies(rng, 0, 60, 80, 7) + near_copies(rng, 100, 25, 30, 3) + near_copies(rng, 200, 12, 12, 2)
    rows += [(300 + i, " ".join(some_text(rng, int(rng.integers(1, 14)), 3))) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "  "), (403, "One TWO"), (404, "one two"), (405, "one"), (406, rows[3][1].upper()), (407, rows[3][1]), (407, rows[3][1]), (408, "Ä b"), (409, "ä b"), (410, "z " * 3000), (411, "z z z z z")]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect())
    assert got == plain_components(rows)


def test_join_of_awkward_tables(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0
    got = jaccard_join.near_duplicates(docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("5", 2, "5"), ("None", 0, "None"), ("None", 2, "5")]
    kept = jaccard_join.clean(docs(spark, [(3, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, "")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 6, 7]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard_join.components(edges, "test-chain").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_written_tables_live_in_the_shared_folder(spark):
    df = common.written(spark.range(10).toDF("x"), "test")
    assert df.count() == 10 and all(common.shared_dir(spark).replace("file://", "") in f for f in df.inputFiles())
    common.forget(df)


# --- the pipeline ---


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    at, counts = d, [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.written(stage(spark, at, SF), f"test-{name}")
        assert at.columns == d.columns
        counts.append(at.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] > 0.5 * counts[0]
    components = {(r[0], r[2]) for r in plain_components([(r["doc_id"], r["text"]) for r in at.collect()])}
    assert all(a == b for a, b in components)
    out = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert set(d.columns) <= set(out.columns) and out.count() > 0
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        empty = empty.select(*d.columns)
