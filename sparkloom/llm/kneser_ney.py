"""Quality classifier: interpolated modified Kneser-Ney bigram model of trusted text, down to the spelling of words.

Tokens. A text is its words (between ASCII white space), each a 32-bit hash, so
there is no closed vocabulary: every word of every trusted document is counted.
A word equal to the one before it is the symbol of its place in the run (second,
third, ...); a text ends with ``EOS``. Runs longer than any seen cost the word's
spelling and one event in all that were seen, so repetitions stay improbable.

Training. Counts of words and of pairs of neighbours are gathered from all trusted
documents, summed per task first and then by Spark. All that modified Kneser-Ney
needs follows from them by joins and aggregates: contexts of a word are its pairs
seen more than once and what is left of its count; discounts come from counts of
counts, one each for counts of one, two, and three or more. The classifier keeps all
pairs and words. ``train`` alone cuts off pairs seen once, and words seen after one
word only, unless asked for the whole model; a cut-off is a discount of one, so their
mass goes to the next lower order. Below the words stands a trigram model of
characters (a fixed table over 64 classes of bytes), so unseen words cost what
their spelling costs.

Scoring. Each event needs the count of its pair and the rows of its two words.
Where the tables have at most ``resident`` rows (their number is counted; 20 bytes
each at most) they are broadcast and texts are scored where they lie. Tables of up
to ``PASSES`` times that are parted by the second word of the pairs, and texts are
read once for every part: a text's mean is the sum over the parts. Beyond that,
chunks of texts ask for what they need: their distinct pairs and words go to the
tables as sorted keys, what was found comes back to the chunk, and every chunk is
scored with its own small table. Texts are worked off in ``SLICES`` parts, whose
tables and shuffles go before the next, so disk is bounded. All ways give the same
scores (``_scores_joined`` is the plain form of the last, kept for comparison).

Decision. A trusted document is scored without its own counts (leave one out), so
all of them train the model and set thresholds nevertheless. The mean of n events
is uncertain by about ``slack / sqrt(n)`` nats, which is taken off every log
perplexity, so that short texts are not rejected by chance. A document is rejected
if the rest exceeds its language's threshold: the ``quantile`` over the trusted
documents in this language plus ``margin``. Languages with fewer than
``min_trusted`` trusted documents, and null, use the threshold over all of them.

Edge cases: null and wordless texts have no perplexity and are not kept; very long
texts are worked through in blocks of bytes; null ids never count as trusted;
repeated rows are counted and scored each; with no trusted text there is no
threshold, and documents with words are kept; extra columns are ignored by
``classify`` and returned untouched by ``keep_documents``.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import dropped, free_name, settle, shared_dir, small_batches, table, trim, written

#: The boundary of a text, the mark of single-word counts, the first symbol of a word. Between them: a word's place in a run.
EOS, WORD, FIRST = 0, 1, 1024
#: The row of all events among the single-word counts.
EVENTS = WORD
#: Bytes worked on in one go, pairs gathered in a task before they are sent on.
BLOCK, EMIT = 1 << 18, 750_000
#: Most passes over the texts with a part of the model each; a pass costs the reading and hashing of all texts.
PASSES = 8
#: Texts that ask for their rows together (bytes), parts in which this is done, rows of the model in a bucket of keys.
CHUNK, SLICES, BUCKET = 1 << 24, 4, 1 << 19
ODD = 0x9E3779B97F4A7C15
KINDS = 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    up, down = _powers(ODD, BLOCK + 1), _powers(pow(ODD, -1, 1 << 64), BLOCK + 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            return _powers(ODD, n), _powers(pow(ODD, -1, 1 << 64), n)
        return cls.up, cls.down


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte, and ln of the share of one byte in its class."""
    kind = np.full(256, 63, np.uint8)
    for b in range(256):
        c = chr(b)
        if b in (9, 10, 11, 12, 13, 32):
            kind[b] = 0
        elif "a" <= c <= "z":
            kind[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            kind[b] = 27 + b - 65
        elif "0" <= c <= "9":
            kind[b] = 53
        elif c in ",;:":
            kind[b] = 54
        elif c in ".!?":
            kind[b] = 55
        elif c in "'\"()-":
            kind[b] = 56
        elif b < 128:
            kind[b] = 57
        elif b < 0xC0:
            kind[b] = 58 + (b >> 4) % 4
        else:
            kind[b] = 62
    return kind, -np.log(np.bincount(kind, minlength=KINDS)[kind])


CLASS, SHARE = _classes()
BLANK = CLASS == 0


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its texts begin and end (nulls are empty)."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def cuts(data: np.ndarray, at: np.ndarray, block: int) -> list[int]:
    """Places that part the texts into blocks of about ``block`` bytes: between texts, or at a blank of a longer text."""
    out, end = [int(at[0])], int(at[-1])
    while out[-1] < end:
        here, aim = out[-1], out[-1] + block
        if aim >= end:
            out.append(end)
            continue
        whole = int(at[np.searchsorted(at, aim, "right") - 1])
        if whole <= here:
            whole = int(at[np.searchsorted(at, here, "right")])  # the end of this long text
            lo = aim
            while lo < whole and not BLANK[data[lo : lo + 4096]].any():
                lo += 4096
            if lo < whole:
                whole = min(whole, lo + int(np.argmax(BLANK[data[lo : lo + 4096]])))
        out.append(max(whole, here + 1))
    return out


def events(column, block: int | None = None):
    """Blocks of ``text number, symbol before, symbol`` of a string column, and what spells the words.

    Every text of n words has n + 1 events, none without words. Yields for each
    block: texts, befores, symbols, texts that end and their last symbols, and (bytes,
    begin and end of every word, whether it is a repeated one) for the character model.
    """
    data, at = string_bytes(column)
    marks = cuts(data, at, block or BLOCK)
    open_text, last = -1, EOS  # a text whose end has not been met, and its last symbol
    last_hash, last_place = np.uint64(0), 0
    for lo, hi in zip(marks, marks[1:]):
        d = data[lo:hi]
        blank = BLANK[d]
        starts = ~blank
        starts[1:] &= blank[:-1]
        inside = at[np.searchsorted(at, lo, "left") : np.searchsorted(at, hi, "left")] - lo
        inside = inside[~blank[inside]] if len(inside) else inside
        starts[inside] = True
        stops = ~blank
        stops[:-1] &= blank[1:]
        if len(inside):
            stops[inside[inside > 0] - 1] |= ~blank[inside[inside > 0] - 1]
        start, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        head, tail = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        edges = np.searchsorted(start, at[head : tail + 1] - lo)
        texts = np.repeat(np.arange(head, tail), np.diff(edges))
        up, down = _Powers.of(len(d) + 1)
        sums = np.zeros(len(d) + 1, np.uint64)
        each = np.add(d, 1, dtype=np.uint64)
        each *= up[: len(d)]
        np.cumsum(each, out=sums[1:])
        h = (sums[stop] - sums[start]) * down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        symbol = np.maximum((h >> np.uint64(32)).astype(np.int64), FIRST)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (texts[1:] == texts[:-1])
        if len(h) and texts[0] == open_text:
            same[0] = h[0] == last_hash
        at_run = np.arange(len(h))
        begun = np.maximum.accumulate(np.where(same, 0, at_run)) if len(h) else at_run
        place = at_run - begun + 1
        if len(h) and same[0]:
            place[begun == 0] += last_place
        symbol[same] = np.minimum(place[same], FIRST - 1)
        before = np.zeros(len(h), np.int64)
        before[1:] = np.where(texts[1:] == texts[:-1], symbol[:-1], EOS)
        if len(h):
            before[0] = last if texts[0] == open_text else EOS
        spelled = (d, start, stop, same)
        # texts that end in this block
        ended = np.flatnonzero(np.concatenate((texts[1:] != texts[:-1], [False]))) if len(h) else np.zeros(0, np.int64)
        end_text, end_before = texts[ended], symbol[ended]
        if open_text >= 0 and at[open_text + 1] <= lo or (open_text >= 0 and len(h) and texts[0] != open_text):
            end_text, end_before = np.concatenate(([open_text], end_text)), np.concatenate(([last], end_before))
            open_text = -1
        if len(h):
            open_text, last, last_hash, last_place = int(texts[-1]), int(symbol[-1]), h[-1], int(place[-1])
        yield texts, before, symbol, end_text, end_before, spelled
    if open_text >= 0:
        none = np.zeros(0, np.int64)
        yield none, none, none, np.array([open_text]), np.array([last]), None


def spelled_codes(spelled, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words (all, or those numbered) one after another, their codes (classes of a byte and of the two before it in its word), where words begin, and the codes of their ends."""
    d, start, stop, _ = spelled
    if words is not None:
        start, stop = start[words], stop[words]
    size = stop - start
    first = np.cumsum(size) - size
    d = d[~BLANK[d]] if words is None else d[np.arange(int(size.sum())) + np.repeat(start - first, size)]
    codes = CLASS[d].astype(np.int64)
    last = codes[first + size - 1]
    final = last << 6
    final[size > 1] |= codes[(first + size - 2)[size > 1]] << 12
    b = np.zeros_like(codes)
    b[1:] = codes[:-1] << 6
    b[first] = 0
    codes |= b
    b[1:] = b[:-1] << 6
    b[first] = 0
    codes |= b
    return d, codes, first, final


def spelling(spelled, table: np.ndarray, once: float, words: np.ndarray | None = None) -> np.ndarray:
    """ln p of the spelling of the words of a block (all, or those numbered) under the character model; repeated words are ``once`` less likely."""
    d, codes, first, final = spelled_codes(spelled, words)
    out = table[final]
    if len(first):
        out += np.add.reduceat(table[codes] + SHARE[d], first)
    out[spelled[3] if words is None else spelled[3][words]] += once
    return out


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def count_events(texts: DataFrame, singles: bool = True) -> DataFrame:
    """``kind, code, n``: pairs (0: symbol before << 32 | symbol) and byte-class trigrams (1).

    ``singles``: single words too (kind 0, before is ``WORD``); where all pairs are kept they follow from these.
    """

    def run(batches):
        held, rows, chars = [], 0, np.zeros(KINDS**3, np.int64)

        def out(kind, code, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int8)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["kind", "code", "n"])

        for b in batches:
            for _, before, symbol, _, end_before, spelled in events(b.column(0)):
                codes = np.concatenate(((before << 32) | symbol, end_before << 32))
                if singles:
                    held.append((np.array([WORD << 32 | EVENTS]), np.array([len(codes)])))
                    codes = np.concatenate((codes, (np.int64(WORD) << 32) | symbol, (np.int64(WORD) << 32) | np.zeros(len(end_before), np.int64)))
                held.append(np.unique(codes, return_counts=True))
                rows += len(held[-1][0]) + singles
                if spelled is not None:
                    _, trigrams, _, final = spelled_codes(spelled)
                    chars += np.bincount(trigrams, minlength=KINDS**3) + np.bincount(final, minlength=KINDS**3)
                chars[0] += len(end_before)
                if rows > 2 * EMIT:
                    held = [_merged(held)]
                    rows = len(held[0][0])
                    if rows > EMIT:
                        for lo in range(0, rows, 1 << 17):
                            yield out(0, *(x[lo : lo + (1 << 17)] for x in held[0]))
                        held, rows = [], 0
        if held:
            code, n = _merged(held)
            for lo in range(0, len(code), 1 << 17):
                yield out(0, code[lo : lo + (1 << 17)], n[lo : lo + (1 << 17)])
        used = np.flatnonzero(chars)
        yield out(1, used, chars[used])
        held.clear()
        trim()

    return texts.mapInArrow(run, "kind byte, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4 (Chen and Goodman)."""
    n1, n2, n3, n4 = counts
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def char_model(rows: list) -> np.ndarray:
    """ln p(class | two before) over byte classes, interpolated with the pair and single shares. At most 64^3 rows."""
    n = np.zeros(KINDS**3)
    for r in rows:
        n[r.code] = r.n
    n = n.reshape(KINDS, KINDS, KINDS)
    p = (n.sum((0, 1)) + 0.1) / (n.sum() + 0.1 * KINDS)
    two = n.sum(0)
    p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
    p = (n + 5 * p[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(p).reshape(-1)


class Model:
    """Tables ``pairs (code, n)`` and ``words (symbol, c, b, k)``, the character model, and a few numbers.

    c: count as a context, b: mass left for the lower order, k: distinct contexts.
    ``numbers``: D1, D2 and D3+ of pairs and of words, all distinct contexts, the mass left for spellings.
    """

    def __init__(self, pairs: DataFrame, words: DataFrame, chars: np.ndarray, numbers: tuple):
        self.pairs, self.words, self.chars, self.numbers = pairs, words, chars, numbers
        self.n_pairs, self.n_words = pairs.count(), words.count()
        self.rows = self.n_pairs + self.n_words

    @property
    def once(self) -> float:
        """ln of one event in all distinct ones."""
        return -math.log(self.numbers[6])

    def parts(self, resident_rows: int) -> int:
        """Parts of at most about ``resident_rows`` rows, each with all words; 0 where that takes more than ``PASSES``."""
        if self.rows <= resident_rows:
            return 1
        room = resident_rows - self.n_words
        return -(-self.n_pairs // room) if room > 0 and self.n_pairs <= PASSES * room else 0


def train(trusted: DataFrame, text_col: str = "text", whole: bool = False) -> Model:
    """Fits the model on all rows of ``trusted``; ``whole``: pairs seen once and words seen after one word only are kept."""
    counts = count_events(trusted.select(text_col), singles=not whole)
    if not whole:
        # most pairs occur once; what they sum up to follows from the counts of single words
        counts = counts.filter((F.col("n") > 1) | (F.col("kind") == 1) | (F.shiftrightunsigned("code", 32) == WORD))
    counts = written(counts)
    chars = char_model(counts.filter("kind = 1").select("code", "n").collect())  # at most 64^3 rows
    before, symbol = F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    pair = counts.filter("kind = 0").select("code", before.alias("before"), symbol.alias("symbol"), "n")
    kept, single = pair.filter(F.col("before") != WORD), pair.filter(F.col("before") == WORD)
    seen = kept.agg(F.sum("n").alias("s"), *[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    total = (seen.s if whole else single.filter(F.col("symbol") == EVENTS).agg(F.sum("n")).first()[0]) or 0
    d1, d2, d3 = discounts([total - (seen.s or 0) + seen.n1, seen.n2, seen.n3, seen.n4])
    d1 = d1 if whole else 1.0
    of = [F.count(F.when(F.col("n") == k, 1)).alias(name) for k, name in ((1, "ones"), (2, "twos"))]
    after = kept.groupBy(F.col("before").alias("symbol")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("s"), *of)
    ahead = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("s2"))
    if whole:
        words = ahead.withColumn("c", F.col("s2"))
    else:
        words = single.filter(F.col("symbol") != EVENTS).select("symbol", F.col("n").alias("c")).join(ahead, "symbol", "left")
    words = words.join(after, "symbol", "left").fillna(0, ["kinds", "s", "ones", "twos", "contexts", "s2"])
    b = (F.col("c") - F.col("s") + d1 * F.col("ones") + d2 * F.col("twos") + d3 * (F.col("kinds") - F.col("ones") - F.col("twos"))) / F.col("c")
    words = written(words.select("symbol", "c", b.alias("b"), (F.col("contexts") + F.col("c") - F.col("s2")).alias("k"), "kinds"))
    k = words.agg(F.sum("k").alias("s"), *[F.count(F.when(F.col("k") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    e1, e2, e3 = discounts([k.n1, k.n2, k.n3, k.n4])
    e1 = e1 if whole else 1.0
    all_k = k.s or 0
    held = words.filter("k > 0").agg(F.sum(F.col("k") - F.when(F.col("k") == 1, e1).when(F.col("k") == 2, e2).otherwise(e3))).first()[0] or 0.0
    rest = 1 - held / all_k if all_k else 1.0
    words = words.filter(f"k > {0 if whole else 1} OR kinds > 0").select("symbol", "c", "b", "k")
    return Model(kept.select("code", "n"), words, chars, (d1, d2, d3, e1, e2, e3, max(all_k, 1), rest))


def probability(n, c, b, k, p0, numbers):
    """p of events from the pair's count, the context's count and mass, the word's contexts and its spelling; numpy arrays."""
    d1, d2, d3, e1, e2, e3, all_k, rest = numbers
    one = np.where(k > 0, (k - np.where(k == 1, e1, np.where(k == 2, e2, e3))) / all_k, 0.0) + rest * p0
    two = np.where((n > 0) & (c > 0), (n - np.where(n == 1, d1, np.where(n == 2, d2, d3))) / np.maximum(c, 1), 0.0)
    return two + np.where(c > 0, b, 1.0) * one


def probability_sql(numbers) -> str:
    """The same over columns n, c, b, k, p0 (null n, c, b, k: not in the tables)."""
    d1, d2, d3, e1, e2, e3, all_k, rest = (f"{float(x)!r}D" for x in numbers)
    one = f"(CASE WHEN k > 0 THEN (k - CASE k WHEN 1 THEN {e1} WHEN 2 THEN {e2} ELSE {e3} END) / {all_k} ELSE 0D END + {rest} * p0)"
    two = f"CASE WHEN n > 0 AND c > 0 THEN (n - CASE n WHEN 1 THEN {d1} WHEN 2 THEN {d2} ELSE {d3} END) / c ELSE 0D END"
    return f"{two} + CASE WHEN c > 0 THEN b ELSE 1D END * {one}"


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread evenly over 64 bits, one to one."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Places:
    """Where keys stand among sorted mixed keys, by a table of their leading bits: a few steps for a key, wherever it is."""

    def __init__(self, mixed: np.ndarray):
        self.mixed, self.shift = mixed, np.uint64(64 - max(1, min(26, len(mixed).bit_length())))
        leads = np.bincount((mixed >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first = np.concatenate(([0], np.cumsum(leads))).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys and whether they are there."""
        if not len(self.mixed):
            return np.zeros(len(wanted), np.int32), np.zeros(len(wanted), bool)
        m = _mixed(wanted)
        lead = (m >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        there = np.zeros(len(m), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.mixed[at[left]] == m[left]
            there[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        at[~there] = 0
        return at, there


def _own(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of events with the same two keys (below 2^31 and 2^32): every event's group, sizes and a member of every group."""
    key = (high << 32) | low
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begun = np.flatnonzero(new)
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.diff(begun, append=len(key)), order[begun]


class Resident:
    """The tables as sorted arrays; of several ``parts``, the pairs of one ``part``."""

    def __init__(self, pairs, n, symbols, c, b, k, chars, numbers, part=0, parts=1):
        self.pairs, self.symbols, self.chars, self.numbers, self.part, self.parts = pairs, symbols, chars, numbers, part, parts
        # one row more, for what is not there
        self.n, self.c, self.b, self.k = (np.concatenate((x, np.zeros(1, x.dtype))) for x in (n, c, b, k))

    def __getstate__(self):
        return {k: v.mixed if isinstance(v, Places) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def ready(self) -> Resident:
        """Tables of leading bits are made in each process, not sent."""
        if not isinstance(self.pairs, Places):
            self.pairs, self.symbols = Places(self.pairs), Places(self.symbols)
        return self

    def counts(self, before, symbol) -> tuple:
        """Counts of events of this part: of the pair, of the context, its mass, the word's contexts."""
        at, there = self.pairs.find((before << 32) | symbol)
        at[~there] = len(self.n) - 1
        n = self.n[at]
        at, there = self.symbols.find(symbol)
        at[~there] = len(self.k) - 1
        k = self.k[at]
        # the word before is as a rule the event before
        back = np.empty_like(at)
        back[1:] = at[:-1]
        other = np.ones(len(at), bool)
        other[1:] = before[1:] != symbol[:-1]
        other = np.flatnonzero(other)
        at, there = self.symbols.find(before[other])
        at[~there] = len(self.k) - 1
        back[other] = at
        return n, self.c[back], self.b[back], k

    def without_own(self, texts, before, symbol, here, n, c, k) -> tuple:
        """Counts of the events ``here`` without those of their own texts, of which all events are given."""
        context, size, _ = _own(texts, before)
        texts, symbol, context = texts[here], symbol[here], context[here]
        pair, times, member = _own(context, symbol)
        n = n - times[pair]
        word, _, _ = _own(texts, symbol)
        alone = member[n[member] <= 0]
        return n, c - size[context], k - np.bincount(word[alone], minlength=len(word))[word]


def _gathered(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, mixed and sorted by the first; its batches go as they are copied."""
    t = df.toArrow()
    at, batches = t.num_rows, t.to_batches()
    out = [np.empty(at, np.uint64 if i == 0 else f.type.to_pandas_dtype()) for i, f in enumerate(t.schema)]
    del t
    while batches:
        b = batches.pop()
        at -= b.num_rows
        for i, x in enumerate(out):
            values = b.column(i).to_numpy(zero_copy_only=False)
            x[at : at + b.num_rows] = values if i else _mixed(values)
        del b
    trim()
    order = np.argsort(out[0])
    out[1:] = [x[order] for x in out[1:]]
    del order
    out[0].sort()
    return out


def resident(model: Model, part: int = 0, parts: int = 1):
    """The broadcast tables of a model or a part of bounded size (counted by the caller): 12 bytes a pair, 20 a word."""
    narrow = lambda c: F.least(F.col(c), F.lit(2**31 - 1)).cast("int").alias(c)
    pairs = model.pairs if parts == 1 else model.pairs.filter(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)) % parts == part)
    pairs = _gathered(pairs.select("code", narrow("n")))
    settle()
    words = _gathered(model.words.select("symbol", narrow("c"), F.col("b").cast("float"), narrow("k")))
    return model.pairs.sparkSession.sparkContext.broadcast(Resident(*pairs, *words, model.chars, model.numbers, part, parts))


def column_scores(column, held: Resident, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Events (words and the end; 0 without words) and mean negative ln p (a part's share of it) of every text of a string column.

    With ``own``, without the texts' own counts. A part spells and looks up its own events only.
    """
    held = held.ready()
    n, sums = np.zeros(len(column), np.int64), np.zeros(len(column))
    floor, once = held.chars[0], -math.log(held.numbers[6])
    waiting, open_text = [], -1  # with ``own``, events wait for the end of their text

    def add(parts):
        texts, before, symbol, here, p0 = (np.concatenate(x) for x in zip(*parts))
        if not len(texts):
            return
        lo = int(texts.min())
        texts = texts - lo
        count = np.bincount(texts)
        here = np.flatnonzero(here) if held.parts > 1 else slice(None)
        pair, c, b, k = held.counts(before[here], symbol[here])
        if own:
            pair, c, k = held.without_own(texts, before, symbol, here, pair, c, k)
        logs = np.log(probability(pair, c, b, k, p0[here], held.numbers))
        n[lo : lo + len(count)] += count
        sums[lo : lo + len(count)] += np.bincount(texts[here], logs, len(count))

    for texts, before, symbol, end_text, end_before, spelled in events(column):
        symbol = np.concatenate((symbol, np.zeros(len(end_text), np.int64)))
        here, p0 = symbol % held.parts == held.part, np.full(len(symbol), math.exp(floor))
        if spelled is not None:
            words = np.flatnonzero(here[: len(texts)]) if held.parts > 1 else None
            p0[slice(len(texts)) if words is None else words] = np.exp(spelling(spelled, held.chars, once, words))
        waiting.append((np.concatenate((texts, end_text)), np.concatenate((before, end_before)), symbol, here, p0))
        if len(texts):
            open_text = int(texts[-1])
        elif open_text in end_text:
            open_text = -1
        if own and open_text >= 0:
            add([tuple(x[p[0] != open_text] for x in p) for p in waiting])
            waiting = [tuple(x[p[0] == open_text] for x in p) for p in waiting]
        else:
            add(waiting)
            waiting = []
    if waiting:
        add(waiting)
    return n, -sums / np.maximum(n, 1)


def _kinds(docs: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)


def _scores_resident(docs: DataFrame, held, columns: list[str], own: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            n, mean = column_scores(b.column(b.num_columns - 1), held.value, own)
            out = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.maximum(n - 1, 0)), pa.array(mean, pa.float64(), mask=n == 0)], names=[*columns, "n_words", "log_ppl"])
        trim()

    return docs.select(*columns, "text").mapInArrow(run, f"{_kinds(docs, columns)}n_words bigint, log_ppl double")


def text_events(docs: DataFrame, chars: np.ndarray, once: float) -> DataFrame:
    """``text_hash, code, m, mc, lp``: the distinct pairs of every text, how often they and their contexts occur in it, ln p of the spelling."""
    names = ["text_hash", "code", "m", "mc", "lp"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                parts = []
                for texts, before, symbol, end_text, end_before, spelled in events(b.column(1).slice(i, 1)):
                    lp = spelling(spelled, chars, once) if spelled is not None else np.zeros(0)
                    parts.append((np.concatenate(((before << 32) | symbol, end_before << 32)), np.concatenate((lp, np.full(len(end_text), chars[0])))))
                if not parts or not sum(len(p[0]) for p in parts):
                    continue
                code, first, m = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
                lp = np.concatenate([p[1] for p in parts])[first].astype(np.float32)
                context, inverse = np.unique(code >> 32, return_inverse=True)
                mc = np.bincount(inverse, m, len(context)).astype(np.int32)[inverse]
                for lo in range(0, len(code), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    same = b.column(0).take(pa.array(np.full(len(code[s]), i)))
                    yield pa.RecordBatch.from_arrays([same, pa.array(code[s]), pa.array(m[s].astype(np.int32)), pa.array(mc[s]), pa.array(lp[s])], names=names)
        trim()

    return docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "text_hash bigint, code bigint, m int, mc int, lp float")


def _scores_joined(docs: DataFrame, model: Model, columns: list[str], own: bool, small: int = 1_000_000) -> DataFrame:
    """Scores by shuffled joins on hashed keys: for models of any size.

    A score depends on the text alone, so events carry its hash and nothing else of
    the row. They are shuffled to their pairs and to their texts; to their words only
    where more than ``small`` of these are known (at most that many are broadcast).
    """
    few = F.broadcast if model.words.count() <= small else lambda df: df
    e = text_events(docs, model.chars, model.once)
    e = e.join(model.pairs, "code", "left")
    e = e.withColumn("before", F.shiftrightunsigned("code", 32)).withColumn("symbol", F.col("code").bitwiseAND(F.lit((1 << 32) - 1)))
    if few is F.broadcast:
        e = e.repartition("text_hash")  # words are looked up after the last shuffle, so nothing of theirs is shuffled
    e = e.join(few(model.words.select(F.col("symbol").alias("before"), "c", "b")), "before", "left").join(few(model.words.select("symbol", "k")), "symbol", "left")
    e = e.fillna(0, ["n", "c", "b", "k"]).withColumn("p0", F.exp(F.col("lp").cast("double")))
    if own:
        if few is not F.broadcast:
            e = e.repartition("text_hash")
        e = e.dropDuplicates(["text_hash", "code"])  # repeated texts: each leaves out its own counts once
        e = e.withColumn("n", F.col("n") - F.col("m")).withColumn("c", F.col("c") - F.col("mc"))
        e = e.withColumn("k", F.col("k") - F.sum((F.col("n") <= 0).cast("long")).over(W.partitionBy("text_hash", "symbol")))
    each = e.groupBy("text_hash").agg((-F.sum(F.col("m") * F.log(F.expr(probability_sql(model.numbers)))) / F.sum("m")).alias("log_ppl"))
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")))
    rows = docs.select(*columns, F.xxhash64("text").alias("__text"), n_words.cast("long").alias("n_words"))
    return rows.join(each.withColumnRenamed("text_hash", "__text"), "__text", "left").select(*columns, "n_words", "log_ppl")


def _packed(mixed: np.ndarray) -> bytes:
    """Sorted mixed keys as differences, byte by byte: the leading bytes are zeros, which compress."""
    return np.diff(mixed, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(keys: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _values(columns: list[np.ndarray]) -> np.ndarray:
    """Columns of four bytes side by side, as bytes of rows."""
    return np.hstack([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 4) for c in columns])


ASKED = "bucket int, kind byte, chunk bigint, keys binary, vals binary"
FOUND = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("vals", pa.binary())])


def _dealt(kind: int, chunk: int, mixed: np.ndarray, values: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Sorted keys (and their values) as one row for every bucket: the leading ``bits`` of keys."""
    ends = np.searchsorted(mixed, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    spans = [(j, lo, hi) for j, (lo, hi) in enumerate(zip([0, *ends], [*ends, len(mixed)])) if hi > lo]
    n = len(spans)
    keys, vals = [_packed(mixed[lo:hi]) for _, lo, hi in spans], [None if values is None else values[lo:hi].T.tobytes() for _, lo, hi in spans]
    columns = [pa.array([j for j, _, _ in spans], pa.int32()), pa.array([kind] * n, pa.int8()), pa.array([chunk] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "chunk", "keys", "vals"])


def _held_keys(model: Model, bits: int) -> DataFrame:
    """The tables of a model, as rows of sorted keys and values for every bucket."""
    narrow = lambda c: F.least(F.col(c), F.lit(2**31 - 1)).cast("int").alias(c)

    def pack(kind):
        def run(batches):
            held, rows = [], 0

            def out():
                key, *columns = (np.concatenate(x) for x in zip(*held))
                mixed = _mixed(key)
                order = np.argsort(mixed)
                held.clear()
                return _dealt(kind, 0, mixed[order], _values([c[order] for c in columns]), bits)

            for b in batches:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
                rows += b.num_rows
                if rows > 2 * EMIT:
                    yield out()
                    rows = 0
            if rows:
                yield out()
            trim()

        return run

    pairs = model.pairs.select("code", narrow("n")).mapInArrow(pack(0), ASKED)
    return pairs.unionAll(model.words.select("symbol", narrow("c"), F.col("b").cast("float"), narrow("k")).mapInArrow(pack(1), ASKED))


def _in_chunks(texts: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, text and ``chunk``: neighbours of about ``CHUNK`` bytes in all."""

    def run(batches):
        chunk, room = TaskContext.get().partitionId() << 32, CHUNK
        for b in batches:
            data, at = string_bytes(b.column(b.num_columns - 1))
            number = chunk + (at[1:] - at[0] + CHUNK - room) // CHUNK
            if b.num_rows:
                room = CHUNK - int((at[-1] - at[0] + CHUNK - room) % CHUNK)
                chunk = int(number[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], names=[*columns, "text", "__chunk"])

    return texts.mapInArrow(run, f"{_kinds(texts, columns)}text string, __chunk bigint")


def _by_chunk(batches):
    """Rows of one chunk that follow each other, of batches with the chunk in their last column."""
    for b in batches:
        chunk = b.column(b.num_columns - 1).to_numpy()
        marks = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for lo, hi in zip(marks, marks[1:]):
            if hi > lo:
                yield int(chunk[lo]), b.slice(lo, hi - lo)


def _asked_keys(chunked: DataFrame, bits: int) -> DataFrame:
    """The distinct pairs and words of every chunk as sorted keys, a row for every bucket."""

    def run(batches):
        held, now = [], None

        def out():
            codes = np.unique(np.concatenate(held)).view(np.uint64)
            held.clear()
            for kind, keys in ((0, codes), (1, np.unique(np.concatenate((codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)))))):
                yield _dealt(kind, now, np.sort(_mixed(keys)), None, bits)

        for chunk, b in _by_chunk(batches):
            if held and chunk != now:
                yield from out()
            now = chunk
            for _, before, symbol, _, end_before, _ in events(b.column(0)):
                held.append(np.unique(np.concatenate(((before << 32) | symbol, end_before << 32))))
            if len(held) > 64:
                held[:] = [np.unique(np.concatenate(held))]
        if held:
            yield from out()
        trim()

    return chunked.select("text", "__chunk").mapInArrow(run, ASKED)


def _table(folder: str, *kinds: int) -> list[list[np.ndarray]]:
    """Sorted keys and columns of the rows of each kind in a folder of packed rows (none, if it is not there)."""
    fs, base = pafs.FileSystem.from_uri(folder)
    parts = {kind: [] for kind in kinds}
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("part-"):
            with fs.open_input_file(f.path) as source:
                t = pq.ParquetFile(source).read(columns=["kind", "keys", "vals"])
            for kind, k, v in zip(*(t.column(i).to_pylist() for i in range(3))):
                if kind in parts:
                    parts[kind].append((_unpacked(k), np.frombuffer(v, np.uint8).reshape(12 if kind else 4, -1).T))
    out = []
    for kind in kinds:
        columns = [np.int32, np.float32, np.int32] if kind else [np.int32]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts[kind])])
        vals = np.concatenate([np.zeros((0, 4 * len(columns)), np.uint8), *(v for _, v in parts[kind])])
        order = np.argsort(keys)
        out.append([keys[order], *(np.ascontiguousarray(vals[order, 4 * i : 4 * i + 4]).view(t).ravel() for i, t in enumerate(columns))])
    return out


def _found(batches, folder: str):
    """What chunks ask for, of rows by bucket and kind; a bucket of the model is read once for all of its rows."""
    at = None
    for b in batches:
        rows = {"chunk": [], "kind": [], "keys": [], "vals": []}
        for bucket, kind, chunk, k in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (bucket, kind) != at:
                (keys, *columns), at = _table(f"{folder}/bucket={bucket}", kind)[0], (bucket, kind)
            wanted = _unpacked(k)
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
            if hit.any():
                for name, x in zip(rows, (chunk, kind, _packed(wanted[hit]), _values([c[place[hit]] for c in columns]).T.tobytes())):
                    rows[name].append(x)
        yield pa.RecordBatch.from_pydict(rows, schema=FOUND)
    trim()


def _scores_asked(model: Model, *jobs: tuple[DataFrame, list[str], bool]) -> list[DataFrame]:
    """Scores of each of ``jobs`` (docs, columns, own) for models of any size: chunks of texts ask for their rows of the model.

    Asked and found keys take about as many bytes as the texts, all in all; a slice's go before the next.
    """
    spark = model.pairs.sparkSession
    bits = max(1, (model.rows // BUCKET).bit_length())
    root = f"{shared_dir(spark).rstrip('/')}/asked-{uuid.uuid4().hex}"
    buckets = _held_keys(model, bits).repartition(1 << bits, "bucket")
    buckets.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/model")
    del buckets
    constant = spark.sparkContext.broadcast((model.chars, model.numbers))
    out = []
    for job, (docs, columns, own) in enumerate(jobs):
        shares = []
        for part in range(SLICES):
            at = f"{root}/{job}-{part}"
            mine = docs.select(*columns, "text").filter(F.pmod(F.xxhash64("text", *columns), F.lit(SLICES)) == part)
            chunked = written(_in_chunks(mine, columns), f"{at}/texts")
            asked = _asked_keys(chunked, bits).repartition(1 << bits, "bucket", "kind").sortWithinPartitions("bucket", "kind")
            found = asked.mapInArrow(lambda batches: _found(batches, f"{root}/model"), "chunk bigint, kind byte, keys binary, vals binary")
            found.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(f"{at}/found")

            def run(batches, folder=f"{at}/found", own=own, columns=columns):
                now, table = None, None
                for chunk, b in _by_chunk(batches):
                    if chunk != now:
                        now, table = chunk, None
                        pairs, words = _table(f"{folder}/chunk={chunk}", 0, 1)
                        table = Resident(*pairs, *words, *constant.value)
                    n, mean = column_scores(b.column(b.num_columns - 2), table, own)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.maximum(n - 1, 0)), pa.array(mean, pa.float64(), mask=n == 0)], names=[*columns, "n_words", "log_ppl"])
                trim()

            shares.append(written(chunked.mapInArrow(run, f"{_kinds(docs, columns)}n_words bigint, log_ppl double"), f"{root}/scores-{job}-{part}"))
            del chunked, asked, found
            dropped(spark, at)
        out.append(reduce(DataFrame.unionAll, shares))
    dropped(spark, f"{root}/model")
    return out


def _scores_passes(model: Model, parts: int, *jobs: tuple[DataFrame, list[str], bool]) -> list[DataFrame]:
    """Scores of each of ``jobs`` (docs, columns, own), with a part of the model broadcast at a time; texts stay, their hashes join the passes."""
    shares = [[] for _ in jobs]
    for part in range(parts):
        held = resident(model, part, parts)
        settle()
        for (docs, _, own), done in zip(jobs, shares):
            done.append(written(_scores_resident(docs.select(F.xxhash64("text").alias("__text"), "text"), held, ["__text"], own)))
        held.destroy()
    out = []
    for (docs, columns, _), done in zip(jobs, shares):
        every = reduce(DataFrame.unionAll, done)
        # copies of a text have the same share in every pass
        each = every.groupBy("__text").agg(F.max("n_words").alias("n_words"), (F.avg("log_ppl") * parts).alias("log_ppl"))
        out.append(docs.select(*columns, F.xxhash64("text").alias("__text")).join(each, "__text", "left").select(*columns, "n_words", "log_ppl"))
    return out


def score(docs: DataFrame, model: Model, columns: list[str], own: bool = False, resident_rows: int = 8_000_000) -> DataFrame:
    """``columns``, ``n_words`` and ``log_ppl`` (null without words) of every row; ``own``: the rows are trusted, leave each out."""
    parts = model.parts(resident_rows)
    if parts > 1:
        return _scores_passes(model, parts, (docs, columns, own))[0]
    if parts:
        return _scores_resident(docs, resident(model), columns, own)
    return _scores_asked(model, (docs, columns, own))[0]


def trusted_documents(docs: DataFrame, labels: DataFrame, small: int = 1_000_000) -> DataFrame:
    """Documents with a label of quality 1. At most ``small`` ids (8 MB, below 40 MB as a hash table) are broadcast, more are shuffled."""
    ids = written(labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= small else ids, "doc_id", "left_semi")


def thresholds(trusted_scores: DataFrame, quantile: float, slack: float, margin: float, min_trusted: int) -> tuple[dict, float | None]:
    """The threshold by language with enough trusted documents; and the threshold over all."""
    top = F.percentile_approx(F.expr(f"log_ppl - {slack} / sqrt(greatest(n_words, 1))"), quantile, 10_000) + margin
    by = trusted_scores.filter("lang IS NOT NULL AND n_words > 0").groupBy("lang").agg(top.alias("threshold"), F.count(F.lit(1)).alias("n"))
    every = trusted_scores.filter("n_words > 0").agg(top.alias("t")).first()["t"]
    return {r.lang: r.threshold for r in by.filter(F.col("n") >= min_trusted).collect()}, every  # one row for each language with trusted text


def _fitted(docs: DataFrame, labels: DataFrame, columns: list[str], quantile: float, slack: float, margin: float, min_trusted: int, resident_rows: int):
    """The broadcast tables (None where they are too large), else the scores of ``docs`` with ``columns``; and the thresholds."""
    small_batches(docs.sparkSession)
    trusted = trusted_documents(docs.select("doc_id", "lang", "text"), labels)
    model = train(trusted, whole=True)
    parts, held, scores = model.parts(resident_rows), None, None
    if parts == 1:
        held = resident(model)
        settle()
        of_trusted = _scores_resident(trusted, held, ["lang"], True)
    elif parts:
        of_trusted, scores = _scores_passes(model, parts, (trusted, ["lang"], True), (docs, columns, False))
    else:
        of_trusted, scores = _scores_asked(model, (trusted, ["lang"], True), (docs, columns, False))
    return held, scores, *thresholds(written(of_trusted), quantile, slack, margin, min_trusted)


def _limit(limits: dict, every: float | None):
    """The threshold of a row's language as a column."""
    out = F.lit(math.inf if every is None else every).cast("double")
    for lang, t in limits.items():
        out = F.when(F.col("lang") == lang, F.lit(t)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 4.0, margin: float = 0.1, min_trusted: int = 30, resident_rows: int = 8_000_000) -> DataFrame:
    """``doc_id, lang, n_words, log_ppl, threshold, keep`` of every document."""
    docs = docs.select("doc_id", "lang", "text")
    held, out, limits, every = _fitted(docs, labels, ["doc_id", "lang"], quantile, slack, margin, min_trusted, resident_rows)
    out = _scores_resident(docs, held, ["doc_id", "lang"], False) if held else out
    limit = _limit(limits, every) + F.expr(f"{slack} / sqrt(greatest(n_words, 1))")
    keep = (F.col("n_words") > 0) & (F.col("log_ppl") <= F.col("threshold"))
    shown = F.when((F.col("n_words") > 0) & (F.col("threshold") < math.inf), F.col("threshold"))
    return out.withColumn("threshold", limit).select("doc_id", "lang", "n_words", "log_ppl", shown.alias("threshold"), F.coalesce(keep, F.lit(False)).alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 4.0, margin: float = 0.1, min_trusted: int = 30, resident_rows: int = 8_000_000, small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. Decided row by row where the tables are broadcast whole.

    Else hashes of rejected texts are joined; at most ``small`` (40 MB) are broadcast, more are shuffled, and texts with them.
    """
    h = free_name(docs, "text_hash")
    hashed = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    held, scores, limits, every = _fitted(hashed, labels, ["lang", "h"], quantile, slack, margin, min_trusted, resident_rows)
    if not held:
        # a decision depends on language and text alone; those rejected are fewer than those kept
        good = (F.col("n_words") > 0) & (F.col("log_ppl") <= _limit(limits, every) + F.expr(f"{slack} / sqrt(greatest(n_words, 1))"))
        bad = written(scores.filter(~F.coalesce(good, F.lit(False))).select(F.col("lang").alias("__l"), F.col("h").alias("__h")).distinct())
        keyed = docs.withColumn(h, F.xxhash64("text"))
        same = keyed["lang"].eqNullSafe(bad["__l"]) & (keyed[h] == bad["__h"])
        return keyed.join(F.broadcast(bad) if bad.count() <= small else bad, same, "left_anti").drop(h)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")
    fall = math.inf if every is None else every

    def run(batches):
        for b in batches:
            n, mean = column_scores(b.column(text_at), held.value, False)
            limit = np.array([limits.get(x, fall) for x in b.column(lang_at).to_pylist()], float)
            yield b.filter(pa.array((n > 0) & (mean <= limit + slack / np.sqrt(np.maximum(n - 1, 1)))))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Perplexity and decision of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
