"""Toxicity by noisy-channel deobfuscation and a classifier of restored text.

Restoring. What is written may be a noisy form of what is meant: letters
replaced by digits and signs, letters spaced out or dotted, letters repeated. A
written chunk is a lattice: each run of a character offers the letter itself,
the letters it may stand for, one or two of a repeated letter, and separators
offer nothing or a word boundary. Viterbi decoding finds the path of highest
probability under a character trigram model with a cost per kind of noise. Only
a chunk with one path, of letters without a repeated one, is not decoded.

Character model. Trigram counts over *all* documents, summed per partition and
then by Spark, over a closed alphabet of 128 symbols: at most 128^3 counts.

Classifier. Words of the restored text give hashed parts (5-grams, beginnings,
whole short words; ``2^22`` buckets, so tables have a fixed bound). Document
frequencies per label over *all* labelled training rows choose the parts whose
log-odds exceeds ``bound`` with confidence. A ridge-regularised logistic
regression on the chosen parts that a document holds, and the log of its words,
is fitted on a bounded sample of about ``sample`` labelled rows (by id hash).

Labels of rows with crc32(doc_id) mod 5 = 0 are never read. Edge cases: null and
empty texts get the score of a text without words; documents without a label
are scored like all; null ids have no remainder and count as not held out; several
labels of one document count as toxic if one is; without training labels
every score is about 0; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import REMEMBERED, cut, small_batches, table, trim

SYMBOLS = 128
BUCKETS = 1 << 22
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
SEPARATORS = set(" .-_*~'’·/\\,")
#: Signs that stand for no letter: around a word they are boundaries on every path.
AROUND = "".join(c for c in string.punctuation + "…’·“”„«»" if c not in LEET)
#: Costs in nats of a replaced letter, of a dropped repetition, of a dropped separator.
REPLACED, REPEATED, DROPPED = 1.0, 0.5, 0.2
_SIGNS = "".join(c for c in LEET if not c.isalnum())
_ONE = rf"(?:[^\W_]|[{re.escape(_SIGNS)}])"
#: Three and more single characters, signs that stand for letters among them, with separators between.
SPACED = re.compile(rf"(?<![^\W_])(?<![{re.escape(_SIGNS)}])(?:{_ONE}[ .\-_*]{{1,2}}){{2,}}{_ONE}(?![^\W_])")


RUNS, TWICE = re.compile(r"(.)\1*", re.DOTALL), re.compile(r"(.)\1", re.DOTALL)


def _alphabet() -> np.ndarray:
    """Symbol of every code point below 65536: 0 for what is no letter, a-z as 1-26, other letters folded to the rest."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return out


ALPHABET = _alphabet()


def stream(text: str) -> np.ndarray:
    """Symbols of a text."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return ALPHABET[np.where(cp < 1 << 16, cp, 0)]


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code, n``: symbol trigrams of all texts (runs of non-letters are one boundary)."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 256):
                a = stream(" ".join(t or "" for t in texts[lo : lo + 256]) + " ").astype(np.int32)
                a = np.concatenate(([0, 0], a[(a > 0) | np.concatenate(([True], a[:-1] > 0))]))
                total += np.bincount((a[:-2] << 14) | (a[1:-1] << 7) | a[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    return docs.select(text_col).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(counts: DataFrame) -> np.ndarray:
    """ln P(c | two before), interpolated with the bigram and unigram shares; at most 128^3 rows are read."""
    rows = counts.toPandas()
    n = np.zeros(SYMBOLS**3)
    n[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = (n.sum((0, 1)) + 0.1) / (n.sum() + 0.1 * SYMBOLS)
    two = n.sum(0)
    p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
    p = (n + 5 * p[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def _run_options(c: str, n: int) -> list[tuple[str, float]]:
    """Options (what is meant, cost) of a run of n equal characters (all from 3 on cost the same)."""
    options = []
    if c.isalpha():
        options += [(c, REPEATED * (n > 1))] + [(c + c, REPEATED * (n > 2))] * (n > 1)
    elif c in LEET:
        options += [(x, REPLACED + REPEATED * (n > 1)) for x in LEET[c]] + [(x + x, REPLACED + REPEATED * (n > 2)) for x in LEET[c] if n > 1]
        options += [(" ", REPLACED + 4.0)]
    else:
        options += [(" ", 0.0)]
    if c in SEPARATORS:
        options += [("", DROPPED)]
    return options


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """Options of every run of equal characters."""
    return [_run_options(m[1], len(m[0])) for m in RUNS.finditer(chunk.lower())]


def _symbol(c: str) -> int:
    return int(ALPHABET[ord(c)]) if ord(c) < 1 << 16 else 0


def doubled(word: str, flat) -> str:
    """The most probable restored form of a word of letters, in which only repeated letters leave a choice.

    Whether a letter is kept twice changes the trigrams of that letter and its two
    neighbours only, whatever is chosen elsewhere, so each run is decided on its own.
    """
    out, v = [], 0
    runs = [(m[1], len(m[0])) for m in RUNS.finditer(word)]
    for i, (c, n) in enumerate(runs):
        z = _symbol(c)
        if n > 1:
            x = _symbol(runs[i + 1][0]) if i + 1 < len(runs) else 0
            once = flat[v << 14 | z << 7 | x] - REPEATED
            twice = flat[v << 14 | z << 7 | z] + flat[z << 14 | z << 7 | x] - REPEATED * (n > 2)
            out.append(c if once >= twice else c + c)
        else:
            out.append(c)
        v = z
    return "".join(out)


@functools.lru_cache(4096)
def _moves(c: str, n: int) -> tuple:
    """The options of a run as (cost, symbols and characters in turn)."""
    return tuple((cost, tuple((z, x if z else " ") for x in meant for z in (_symbol(x),))) for meant, cost in _run_options(c, n))


def viterbi(chunk: str, model: np.ndarray) -> str:
    """The most probable restored form of a chunk. Paths are kept as links to their beginnings, so long chunks stay linear."""
    flat = memoryview(model.reshape(-1))
    paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the two symbols before, packed
    for moves in [*(_moves(m[1], min(len(m[0]), 3)) for m in RUNS.finditer(chunk.lower())), _moves("%", 1)]:
        new: dict[int, tuple[float, tuple | None]] = {}
        for at, (score, path) in paths.items():
            for cost, meant in moves:
                uv, s, t = at, score - cost, path
                for z, c in meant:
                    if z == 0 and uv & 127 == 0:
                        continue
                    s += flat[uv << 7 | z]
                    uv, t = (uv << 7 | z) & 16383, (t, c)
                if uv not in new or new[uv][0] < s:
                    new[uv] = (s, t)
        paths = new
    _, path = max(paths.values(), key=lambda p: p[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


class Restored(dict):
    """Chunk -> restored lower-case chunk, remembered up to a bound."""

    def __init__(self, model: np.ndarray, bound: int = REMEMBERED):
        super().__init__()
        self.model, self.bound, self.flat = model, bound, memoryview(model.reshape(-1))

    def __missing__(self, chunk: str) -> str:
        low = chunk.lower()
        core = low.rstrip(".,;:!?")
        inner = low.strip(AROUND)  # signs that only can be boundaries
        if inner.isalpha() and (inner.isascii() or ord(max(inner)) < 1 << 16):
            out = doubled(inner, self.flat) if TWICE.search(inner) else inner
        elif core.isalpha():
            out = viterbi(chunk, self.model) if TWICE.search(core) else low
        else:
            noisy = bool(core) and (sum(c.isalpha() for c in core) >= 2 or any(len(options) > 1 for options in lattice(core)))
            out = viterbi(chunk, self.model) if noisy else low
        if len(self) >= self.bound:
            self.clear()
        self[chunk] = out
        return out


_KNOWN: list[Restored] = []


def known_chunks(model: np.ndarray) -> Restored:
    """This process's memory of restored chunks under a model, kept from task to task."""
    if not _KNOWN or _KNOWN[0].model is not model:
        _KNOWN[:] = [Restored(model)]
    return _KNOWN[0]


def restore(text: str | None, known: Restored) -> str:
    """A whole text with every chunk restored; spaced-out letters are one chunk."""
    text = SPACED.sub(lambda m: viterbi(m[0], known.model), text or "")
    return " ".join(map(known.__getitem__, text.split()))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed parts of the words of several texts: bucket and text number of each; and the words of each text.

    Parts are 5-grams with one boundary at most on either side, beginnings of
    3 to 8 symbols, and whole words of up to 7.
    """
    a = np.concatenate([x for t in texts for x in (_EDGE, stream(t), _EDGES)] or [_EDGES]).astype(np.int64)
    sizes = np.array([len(t) + len(_EDGE) + len(_EDGES) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = a > 0
    at = np.flatnonzero(letter[1:-3] & letter[2:-2] & letter[3:-1]) if len(a) > 4 else np.zeros(0, np.int64)
    at = at[at + 4 < len(a)]
    codes, docs = [(a[at] << 28) | (a[at + 1] << 21) | (a[at + 2] << 14) | (a[at + 3] << 7) | a[at + 4]], [doc[at]]
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    words = np.bincount(doc[start], minlength=len(texts)) if len(start) else np.zeros(len(texts), np.int64)
    code = np.zeros(len(start), np.int64)
    for k in range(1, 9):  # every text ends in eight boundaries, so start + k stays inside
        code = (code << 7) | a[start + k - 1]
        alive = letter[start + k - 1]
        start, code = start[alive], code[alive]
        if k >= 3:
            codes.append(code ^ (k << 57))
            docs.append(doc[start])
        if k <= 7:
            whole = ~letter[start + k]
            codes.append(code[whole] ^ ((k + 8) << 57))
            docs.append(doc[start[whole]])
    code = np.concatenate(codes).astype(np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64), np.concatenate(docs), words


_EDGE, _EDGES = np.zeros(1, np.uint8), np.zeros(9, np.uint8)


def frequencies(docs: DataFrame, model) -> DataFrame:
    """``bucket, toxic, clean``: in how many labelled documents each part of a word occurs. Columns: text, toxic."""

    def run(batches):
        known, seen = known_chunks(model.value), np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[int(y > 0), np.unique(grams([restore(t, known)])[0])] += 1
        at = np.flatnonzero(seen.any(0))
        for lo in range(0, len(at), 1 << 18):
            i = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, seen[1, i], seen[0, i])], names=["bucket", "toxic", "clean"])

    out = docs.select("text", "toxic").mapInArrow(run, "bucket bigint, toxic bigint, clean bigint")
    return out.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(freq: DataFrame, n_toxic: int, n_clean: int, bound: float) -> np.ndarray:
    """The buckets whose log-odds is at least ``bound`` with confidence, in order: a subset of 2^22."""
    odds = f"ln((toxic + 0.5) / ({n_toxic} - toxic + 0.5)) - ln((clean + 0.5) / ({n_clean} - clean + 0.5))"
    error = f"sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) + 1 / ({n_toxic} - toxic + 0.5) + 1 / ({n_clean} - clean + 0.5))"
    rows = freq.filter(F.expr(f"{odds} - 1.64 * {error} >= {bound}")).select("bucket").toPandas()
    return np.sort(rows["bucket"].to_numpy(np.int64))


def _numbers(chosen: np.ndarray) -> np.ndarray:
    """Bucket -> 1 + its place among the chosen, else 0."""
    out = np.zeros(BUCKETS, np.int32)
    out[chosen] = np.arange(1, len(chosen) + 1)
    return out


def present(texts: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, chosen part) pairs and the words of each text."""
    bucket, doc, words = grams(texts)
    n = number[bucket]
    pair = np.unique((doc[n > 0] << 32) | (n[n > 0] - 1))
    return pair >> 32, pair & 0xFFFFFFFF, words


def sample_features(train: DataFrame, model, chosen) -> DataFrame:
    """``toxic, n_words, parts`` of every row."""

    def run(batches):
        known, number = known_chunks(model.value), _numbers(chosen.value)
        for b in batches:
            parts, words = [], []
            for t in b.column(0).to_pylist():
                _, f, w = present([restore(t, known)], number)
                parts.append(f.tolist())
                words.append(int(w[0]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(words, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["toxic", "n_words", "parts"])

    return train.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, n_words bigint, parts array<int>")


def fit(rows: list, n_parts: int, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression on present parts (first), log words and an intercept (last two); Adam on the full sample."""
    if not rows:
        return np.concatenate((np.zeros(n_parts + 1), [-30.0]))
    y = np.array([r.toxic > 0 for r in rows], float)
    length = np.log1p(np.array([r.n_words for r in rows], float)) / 5
    row = np.repeat(np.arange(len(rows)), [len(r.parts) for r in rows])
    col = np.concatenate([np.array(r.parts, np.int64) for r in rows])
    w = np.zeros(n_parts + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(y)) + length * w[-2] + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate((np.bincount(col, e[row], n_parts) + ridge * w[:-2], [length @ e, e.sum()])) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) / (1 + k / 100)
    return w


def scores(docs: DataFrame, model, chosen, w) -> DataFrame:
    """``doc_id, score`` of every document."""

    def run(batches):
        known, number, coef = known_chunks(model.value), _numbers(chosen.value), w.value
        for b in batches:
            texts = b.column(1).to_pylist()
            z = np.empty(len(texts))
            for lo in range(0, len(texts), 32):
                doc, part, words = present([restore(t, known) for t in texts[lo : lo + 32]], number)
                z[lo : lo + 32] = np.bincount(doc, coef[part], len(words)) + np.log1p(words) / 5 * coef[-2] + coef[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, bound: float = 0.7, small: int = 1_000_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    share = F.expr("crc32(cast(doc_id AS string)) % 5")
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic").filter(share != 0)
    known = cut(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = known.count()
    n_toxic = known.filter("toxic > 0").count()
    docs = docs.select("doc_id", "text")
    train = docs.join(F.broadcast(known) if count <= small else known, "doc_id")
    chars = sc.broadcast(char_model(char_counts(docs)))
    chosen = sc.broadcast(telling(frequencies(train, chars), n_toxic, count - n_toxic, bound))
    of_sample = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, sample / max(count, 1)) * 1_000_000)
    of_sample = of_sample.dropDuplicates(["doc_id"]).repartition(32)  # one row of an id, so repeated rows cannot swell it; dealt over tasks
    w = sc.broadcast(fit(sample_features(of_sample, chars, chosen).collect(), len(chosen.value)))
    out = scores(docs, chars, chosen, w).select("doc_id", F.coalesce(share == 0, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: score and decision for every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
