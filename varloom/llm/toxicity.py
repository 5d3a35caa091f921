"""Toxicity: a noisy channel restores disguised words, then the restored text is scored.

1. Character bigrams are counted over all documents (one scan; what reaches the
   driver is one count for each of 28 x 28 pairs).
2. Words and word beginnings (4 to 6 bytes) that mark toxic rows are learned
   from labelled rows: log-odds of document frequency.  At most ``MAX_TOXIC``
   toxic and ``MAX_CLEAN`` other rows, the first by a hash of their id, are used.
3. Words that look disguised (a digit or sign that may stand for a letter, a
   letter three times in a row, single letters in a row), of any length, become a
   lattice of readings; a Viterbi pass picks the likeliest under the bigram model
   mixed with that of the lexicon's words.  In single letters in a row and in
   tokens of over ``JOINED`` characters, which are not one word, lexicon words of
   three letters at least count at any offset.
4. A document's score is a logistic function of the summed weights of the
   lexicon entries in its restored text, fitted on the same rows.

Learning needs (id, toxic) rows and the texts only; scores use the text alone.

Defined results: null and empty texts get the score of a text without any entry;
rows keep their multiplicity and null ids; without labelled rows of both kinds
every score is 0; null labels are not used, and an id labelled both ways counts as
toxic; very long texts are read whole, in time that grows with their length; an
empty table gives no row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import _U, Words, bounded, ints, load, mix, slices

MAX_TOXIC = 4000
MAX_CLEAN = 8000
#: An entry has to be in this many toxic rows: three, and this share of those used.
MIN_DOCS = 3
MIN_SHARE = 0.01
THRESHOLD = 0.7
#: Evidence is counted in steps of this size when the logistic function is fitted.
STEP = 1 / 256
#: A longer token is taken as words without spaces; also the longest that is kept with its reading.
JOINED = 40

#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
SYMBOLS = 28  # a-z, other letters, none (space, sign, end)


def _letters() -> np.ndarray:
    code = np.full(256, 27, np.int64)
    code[128:] = 26
    for i in range(26):
        code[97 + i] = code[65 + i] = i
    return code


_CODE = _letters()


def bigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character pairs over all texts, 28 x 28."""

    def run(batches):
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                codes = _CODE[np.frombuffer(" ".join(t or "" for t in part.column("text").to_pylist()).encode(), np.uint8)]
                total += np.bincount(codes[:-1] * SYMBOLS + codes[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    out = np.zeros(SYMBOLS * SYMBOLS)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS)


_RUNS = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][\s._\-]+){3,}[^\W_](?=[\s.,;:!?]|$)")
_GAPS = re.compile(r"[\s._\-]+")
_THREE = re.compile(r"([^\W\d_])\1\1")
_HELD = re.compile(r"(.)\1{3,}", re.S)
#: A token from its first letter on, with a sign or digit that may stand for a letter.
_SUSPECT = re.compile(r"(?<![^\W\d])(?<![.'\-])(?:[^\W\d]|[.'\-])*+[0-9@$!|+(€£*#][\w@$!|+(€£*#.'\-]*")
_BREAKS = re.compile(r"[._'\-]+")
_OTHER = re.compile(r"[^\w@$!|+(€£*#.'\-]+")
_WIDE = re.compile(r"\s{2,}")


class Channel:
    """Restores disguised words by a Viterbi pass over their readings."""

    def __init__(self, counts: np.ndarray, lexicon: list[str]):
        own = np.zeros_like(counts)
        for word in lexicon:
            codes = _CODE[np.frombuffer(f" {word} ".encode(), np.uint8)]
            np.add.at(own, (codes[:-1], codes[1:]), 1)
        model = np.zeros_like(own)
        for m in (counts, own):
            model = model + 0.5 * (m + 0.05) / (m + 0.05).sum(axis=1, keepdims=True)
        self.log = np.log(model).tolist()
        self.known: dict[str, str] = {}
        self.words = {w for w in lexicon if len(w) > 2}
        self.sizes = sorted({len(w) for w in self.words})

    def restore(self, token: str) -> str:
        # Three in a row read as any longer run does.
        token = _HELD.sub(r"\1\1\1", token.lower())
        if len(token) > JOINED:
            return self._viterbi(token)
        if token not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[token] = self._viterbi(token)
        return self.known[token]

    def readings(self, text: str) -> list[str]:
        """The parts of text that look disguised, restored, and lexicon words within the joined ones."""
        out = []
        for token, joined in _suspects(text):
            word = self.restore(token)
            out.append(word)
            if joined:
                out.extend(word[i : i + n] for n in self.sizes for i in range(len(word) - n + 1) if word[i : i + n] in self.words)
        return out

    def _viterbi(self, token: str) -> str:
        # Nodes are runs of one character; a run of a letter may be one or two of it, a sign any of its letters.
        log, here = self.log, {27: (0.0, None)}
        for run in re.finditer(r"(.)\1*", token, re.S):
            char, n = run[1], run.end() - run.start()
            readings = [(x, -1.0) for x in LEET.get(char, "")]
            if char.isalpha():
                readings = [(char, 0.0), (char * 2, 0.0 if n > 1 else -50.0)] if n < 3 else [(char, 0.0), (char * 2, -0.5)]
                if n == 2:
                    readings[0] = (char, -3.0)
            elif char in "._-' \t\n":
                readings = [("", 0.0)]
            elif not readings:
                readings = [("", -2.0)]
            after: dict[int, tuple[float, tuple | None]] = {}
            for last, (score, path) in here.items():
                for out, cost in readings:
                    s, state = score + cost, last
                    for c in out:
                        code = ord(c) - 97 if "a" <= c <= "z" else 26
                        s, state = s + log[state][code], code
                    if state not in after or s > after[state][0]:
                        after[state] = (s, (path, out) if out else path)
            here = after
        path, parts = max(here.items(), key=lambda x: x[1][0] + log[x[0]][27])[1][1], []
        while path:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))


def _suspects(text: str) -> list[tuple[str, bool]]:
    """The parts of a text that look disguised, and whether one may be several words."""
    out = []
    for m in _SUSPECT.finditer(text):
        whole = m[0].strip(".'()_-")
        for token in {whole, whole.rstrip("!*#$+|"), *(p for p in _BREAKS.split(whole) if p != whole)}:
            if len(token) > 2 and not token.isalpha():
                out.append((token, len(token) > JOINED))
    for m in _RUNS.finditer(text):
        # A one-letter word may stand before or after the spaced word; wide gaps may be between words.
        letters = _GAPS.sub("", m[0])
        out.extend(((letters, True), (letters[1:], False), (letters[:-1], False)))
        parts = [_GAPS.sub("", p) for p in _WIDE.split(m[0])]
        out.extend((p, False) for p in parts if len(p) > 2 and p != letters)
    end = 0
    for m in _THREE.finditer(text):
        a, b = m.start(), m.end()
        if a < end:
            continue  # in the token before
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        for part in _OTHER.split(text[a:b]):
            for token in {part.strip(".'()*#$+|!_-"), *_BREAKS.split(part)}:
                if _THREE.search(token):
                    out.append((token, len(token) > JOINED))
    return out


def entries(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of its first 4, 5 and 6 bytes if it is longer."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    rows, length = words.rows(), words.ends - words.starts
    with np.errstate(over="ignore"):
        out_rows, out = [rows], [words.hash]
        for size in (4, 5, 6):
            long = length > size
            out_rows.append(rows[long])
            out.append(mix(words.prefixes(True, size)[long] + _U(size)))
    return np.concatenate(out_rows), np.concatenate(out)


class Scorer:
    """What a task needs: the sorted lexicon, its weights, the channel, the logistic function."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, channel: Channel, slope: float, offset: float):
        self.keys, self.weights, self.channel, self.slope, self.offset = keys, weights, channel, slope, offset

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Summed weights of the distinct lexicon entries in each restored text."""
        plain = texts.fill_null("")
        restored = []
        for t in plain.to_pylist():
            restored.append(" ".join(self.channel.readings(t)))
        total = np.zeros(len(plain))
        if not len(self.keys):
            return total
        both = []
        for col in (plain, pa.array(restored, pa.string())):
            rows, keys = entries(Words(col, lower=True, bare=True))
            at = np.searchsorted(self.keys, keys)
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == keys[hit]
            both.append(rows[hit] * len(self.keys) + at[hit])
        pairs = np.unique(np.concatenate(both))
        np.add.at(total, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return total

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.slope:
            return np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.offset + self.slope * np.sqrt(self.evidence(texts)), -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by Newton steps with a small ridge; n: how often each (x, y) is there."""
    b = np.zeros(2)
    a = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (n * (y - p)) - np.array([0.05, 0.05]) * b
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.05])
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(b[0])), float(b[1])


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """labels: (doc_id, toxic) rows to learn from."""
    spark = docs.sparkSession
    bounded(spark)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [
        (r["doc_id"], toxic)
        for toxic, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))
        for r in marked.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()
    ]
    counts = bigrams(docs)
    nothing = Scorer(np.zeros(0, _U), np.zeros(0), Channel(counts, []), 0.0, 0.0)
    n_toxic = sum(t for _, t in picked)
    n_clean = len(picked) - n_toxic
    if not n_toxic or not n_clean:
        return nothing
    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int")), "doc_id").select("toxic", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=True, bare=True)
                rows, keys = entries(words)
                toxic = part.column("toxic").to_numpy()
                keys, at = np.unique(keys, return_inverse=True)
                pairs = np.unique(at * part.num_rows + rows)
                at = pairs // part.num_rows
                bad = np.bincount(at, weights=toxic[pairs % part.num_rows], minlength=len(keys)).astype(np.int64)
                all_ = np.bincount(at, minlength=len(keys))
                # A spelling of each whole word, for the channel's model.
                spelled: dict[int, str] = {}
                if len(words.hash):
                    first = np.unique(words.hash, return_index=True)
                    wanted = set(keys[bad > 0].tolist())
                    for h, i in zip(first[0].tolist(), first[1].tolist(), strict=True):
                        if h in wanted:
                            spelled[h] = bytes(words.data[words.starts[i] : words.ends[i]]).decode("utf-8", "ignore").lower()
                yield pa.RecordBatch.from_arrays([pa.array(ints(keys)), pa.array(bad), pa.array(all_ - bad), pa.array([spelled.get(k) for k in keys.tolist()], pa.string())], names=["key", "bad", "good", "word"])

    odds = F.log((F.col("bad") + 0.2) / (n_toxic + 0.4)) - F.log((F.col("good") + 0.2) / (n_clean + 0.4))
    found = (
        sample.mapInArrow(count, "key bigint, bad bigint, good bigint, word string")
        .groupBy("key")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.min("word").alias("word"))
        .filter(F.col("bad") >= max(MIN_DOCS, math.ceil(MIN_SHARE * n_toxic)))
        .withColumn("odds", odds)
        .filter("odds > 3")
        .orderBy(F.desc("odds"), "key")
        .collect()
    )
    if not found:
        return nothing
    keys = np.array([r["key"] for r in found], np.int64).view(_U)
    order = np.argsort(keys)
    weights = np.array([r["odds"] for r in found])[order]
    scorer = Scorer(keys[order], weights, Channel(counts, [r["word"] for r in found if r["word"]]), 0.0, 0.0)
    shared = spark.sparkContext.broadcast(scorer)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(shared.value.evidence(part.column("text")))], names=["toxic", "x"])

    # Counted by steps of the evidence, so that repeated rows do not add to what reaches the driver.
    step = F.round(F.sqrt("x") / STEP).cast("long")
    seen = sample.mapInArrow(measure, "toxic int, x double").groupBy("toxic", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "step").collect()
    x, y, n = np.array([r["step"] * STEP for r in seen]), np.array([float(r["toxic"]) for r in seen]), np.array([float(r["n"]) for r in seen])
    scorer.slope, scorer.offset = _logistic(x, y, n) if seen else (0.0, 0.0)
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column("text")))], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fitted(spark, sf_dir, docs: DataFrame) -> Scorer:
    labels = load(spark, sf_dir, "labels")
    return learn(docs, labels.filter(~held_out(F.col("doc_id"))))


def op8_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    scored = score(docs, _fitted(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs without the rows that the scorer rejects; no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(part.column(at).cast(pa.string())) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
