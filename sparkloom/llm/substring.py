"""Substring dedup by hashing lines, paragraphs, or parts of lines.

Units. Texts are cut into lines, paragraphs (lines up to an empty one), or parts of
lines: after sentence ends, after every word whose hash is the least among the
``REACH`` words on either side, and after ``LONGEST`` words. A unit is normalised
(lower case, words joined by one blank) and hashed, and digests of all texts are
grouped with partial aggregation.

Lines and paragraphs. The earliest ranked occurrence of a unit (smallest id, then
first in the text) is kept, every other one is removed; neighbours form one span.

Passages. Text that repeats is pasted into lines as often as between them, and its
ends rarely are ends of units. So parts that occur twice only mark where to look:
around runs of them (``EXTEND`` words on either side), the hashes of all windows of
``min_words`` words are grouped the same way, with the first id of each. A second look
at these windows finds runs that repeat. Where a run begins or ends, or a document
may turn from the first to have its windows to a later one, windows are joined with
their first id. Between two such windows that are duplicates, all are. Spans
so consist of whole windows that an earlier document, or the same one at least a
window before, has word by word.

Which parts and windows occur twice, and which document is the first to have a window,
is kept in three bitmaps of ``BITS`` bits (32 MB, broadcast; ``PROBES`` bits a key).
Other keys with the same bits (1 in 1,000 where a bitmap holds 9 million) cost work, as
what they let through is grouped and joined exactly, and can hide a turn: the windows
next to every turn are marked too, so a span can lose a word or a passage of exactly
``min_words`` words only inside text that its document is the first of several to have.
Turns to the first and back within a window's width leave no word uncovered and
are no turns. A hot digest is summed map side first, and the join with the first ids
is split at run time.

Edge cases: null, empty and wordless texts have no units; rows that share an id
(repeated rows too) are one document and only lose what an earlier id or their
own text has before; null ids rank last, and what only they hold is kept in each;
a text is worked through in blocks, whatever its length; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, free_name, settle, small_batches, table, trim, written

REACH, LONGEST = 3, 24
#: Words around a run of repeated parts in which a passage may begin or end, and the words such a run must have.
EXTEND, LEAST = 40, 8
BITS, PROBES = 1 << 28, 3
STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
CLOSING = np.array([ord(c) for c in "\"'”’»)]"], np.uint32)
SPACE = np.array([chr(i).isspace() for i in range(0xFFFF)] + [False])
ODD = 0x9E3779B97F4A7C15
BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    if n <= BLOCK + 1:
        return UP, DOWN
    return _powers(ODD, n), _powers(pow(ODD, -1, 1 << 64), n)


UP, DOWN = _powers(ODD, BLOCK + 1), _powers(pow(ODD, -1, 1 << 64), BLOCK + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _lower(text: str | None) -> str:
    """Lower case, character by character where that alone keeps the length."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Words:
    """The words of several texts: text number, line number, start and end (code points of the joined texts), hash, ends a sentence."""

    def __init__(self, texts: list[str | None]):
        parts = [_lower(t) for t in texts]
        self.n_texts = len(texts)
        self.begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        cp = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.concatenate(([True], SPACE[np.minimum(cp, 0xFFFF)], [True]))
        self.start, self.end = np.flatnonzero(~blank[1:-1] & blank[:-2]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        start, end = self.start, self.end
        self.of = np.searchsorted(self.begin, start, "right") - 1
        self.line = np.cumsum(cp == 10)[start] if len(start) else start
        self.hash = np.zeros(len(start), np.uint64)
        i = 0
        while i < len(start):  # whole words, a block of characters at a time
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, "right")))
            n = int(end[j - 1] - lo)
            up, down = _both_powers(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((cp[lo : lo + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            self.hash[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo]
            i = j
        self.hash = _mix(self.hash)
        last = cp[end - 1] if len(end) else cp[:0]
        for k in (2, 3):
            last = np.where(np.isin(last, CLOSING) & (end - start >= k), cp[np.maximum(end - k, 0)] if len(end) else last, last)
        self.stops = np.isin(last, STOPS)

    def __len__(self) -> int:
        return len(self.start)

    def ends(self, unit: str) -> np.ndarray:
        """The last word of every unit."""
        n = len(self)
        text_ends = np.append(np.flatnonzero(self.of[1:] > self.of[:-1]), n - 1)
        if unit != "part":
            best = np.zeros(n, bool)
            best[:-1] = self.line[1:] - self.line[:-1] >= (2 if unit == "paragraph" else 1)
            best[text_ends] = True
            return np.flatnonzero(best)
        score = np.where(self.stops, np.uint64(1 << 61), np.uint64(2 << 61)) | (self.hash >> np.uint64(3))
        score[:-1][self.line[1:] > self.line[:-1]] &= np.uint64((1 << 61) - 1)
        at = np.arange(n) + REACH * (self.of + 1)  # between texts stands what ends a line
        padded = np.zeros(n + REACH * (self.n_texts + 1), np.uint64)
        padded[at] = score
        best = score < np.uint64(2 << 61)
        best[text_ends] = True
        least = np.ones(n, bool)
        for k in range(1, REACH + 1):
            least &= (score < padded[at - k]) & (score <= padded[at + k])
        best |= least
        first = np.maximum.accumulate(np.where(np.concatenate(([True], best[:-1])), np.arange(n), 0))
        return np.flatnonzero(best | ((np.arange(n) - first) % LONGEST == LONGEST - 1))

    def units(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and digest of every unit."""
        if not len(self):
            return self.start, self.start, self.hash
        last = self.ends(unit)
        first = np.concatenate(([0], last[:-1] + 1))
        size = last - first + 1
        power = _powers(ODD, int(size.max()))
        return first, size, _mix(np.add.reduceat(self.hash * power[np.arange(len(self)) - np.repeat(first, size)], first))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that begins at every word, and whether it lies in one text."""
        n = len(self) - width + 1
        if n <= 0:
            return self.hash[:0], np.zeros(0, bool)
        up, down = _both_powers(len(self) + 1)
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self)], out=sums[1:])
        return _mix((sums[width:] - sums[:n]) * down[:n]), self.of[:n] == self.of[width - 1 :]


def units(text: str | None, unit: str = "part") -> list[tuple[int, int, int, int]]:
    """``digest, start, end, words`` of every unit of one text."""
    w = Words([text])
    first, size, digest = w.units(unit)
    return list(zip(digest.view(np.int64).tolist(), w.start[first].tolist(), w.end[first + size - 1].tolist(), size.tolist()))


def _text_hashes(texts: list[str | None]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 11) for t in texts], np.uint64).view(np.int64)


def _blocks(column, most: int = 64):
    """Numbers of the first text, and texts, of a string column, some at a time."""
    for lo in range(0, len(column), most):
        yield lo, column.slice(lo, most).to_pylist()


def _again(of: np.ndarray, keys: np.ndarray, at: np.ndarray, apart: int) -> np.ndarray:
    """Whether a text has the same key at least ``apart`` before; ``at`` ascends."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((keys, of))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.empty(len(order), np.int64)
    first[order] = at[order[new]][np.cumsum(new) - 1]
    return at - first >= apart


def unit_table(docs: DataFrame, unit: str) -> DataFrame:
    """``doc_id, text_hash, pos, digest, start, end, words, again`` of every unit; again: seen earlier in its text."""
    names = ["doc_id", "text_hash", "pos", "digest", "start", "end", "words", "again"]

    def run(batches):
        for b in batches:
            for lo, texts in _blocks(b.column(1)):
                w = Words(texts)
                first, size, digest = w.units(unit)
                if not len(first):
                    continue
                doc = w.of[first]
                pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
                again = _again(doc, digest, pos, 1)
                cols = [b.column(0).take(pa.array(lo + doc)), pa.array(_text_hashes(texts)[doc]), pa.array(pos.astype(np.int32)), pa.array(digest.view(np.int64))]
                cols += [pa.array(x.astype(np.int32)) for x in (w.start[first] - w.begin[doc], w.end[first + size - 1] - w.begin[doc], size)] + [pa.array(again)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, pos int, digest bigint, start int, end int, words int, again boolean")


def _repeated_units(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    u = unit_table(docs, unit)
    first = cut(u.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_doc"))
    dup = u.join(first, "digest").filter("again OR (first_doc IS NOT NULL AND NOT doc_id <=> first_doc)")
    # repeated rows give the same units again
    each = dup.groupBy("doc_id", "text_hash", "pos").agg(*[F.min(c).alias(c) for c in ("start", "end", "words", "first_doc")])
    each = each.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("pos")))
    spans = each.groupBy("doc_id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min("first_doc").alias("first_doc"))
    return spans.filter(F.col("n_words") >= min_words).drop("island")


def _places(keys: np.ndarray) -> np.ndarray:
    """The bits of every key, one row for each probe."""
    n = np.uint64(BITS.bit_length() - 1)
    first, step = keys >> (np.uint64(64) - n), ((keys >> np.uint64(4)) & np.uint64(BITS - 1)) | np.uint64(1)
    return np.stack([((first + np.uint64(i) * step) & np.uint64(BITS - 1)).astype(np.int64) for i in range(PROBES)])


def _bitmap(table: DataFrame, keys):
    """Broadcast bitmap of the ``keys`` of a table's record batches: words of 64 bits are merged map side first, and reach the driver as blocks of bytes."""

    def words(batches):
        for b in batches:
            place = _places(keys(b)).ravel()
            order = np.argsort(place)
            word, first = np.unique(place[order] >> 6, return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place[order] & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    size = 1 << 13  # words in a block

    def blocks(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            word, bits = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for k in np.unique(word // size).tolist():
                own = word // size == k
                held.setdefault(k, np.zeros(size, "<u8"))[word[own] % size] = bits[own]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bytes"])

    merged = table.mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = merged.repartition(16, F.shiftright("word", 13)).mapInArrow(blocks, "block bigint, bytes binary").toArrow()  # BITS / 8 bytes at most
    held = np.zeros(BITS >> 3, np.uint8)
    for k, raw in zip(rows.column(0).to_pylist(), rows.column(1)):
        held[8 * size * k : 8 * size * (k + 1)] = np.frombuffer(raw.as_buffer(), np.uint8)
    del rows
    out = table.sparkSession.sparkContext.broadcast(held)
    del held
    settle()
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be in a bitmap."""
    out = np.ones(len(keys), bool)
    for place in _places(keys):
        out &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return out


def _of_document(windows: np.ndarray, ids) -> np.ndarray:
    """Keys of windows in the documents of an Arrow column of ids."""
    if pa.types.is_integer(ids.type):
        h = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    else:
        h = np.array([xxhash.xxh64_intdigest(str(x).encode("utf-8", "surrogatepass"), 11) for x in ids.to_pylist()], np.uint64)
    return _mix(windows ^ _mix(h + np.uint64(ODD)))


def _within(flags: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """Stretches of fewer than ``most`` flags with others of their run on both sides."""
    starts = begins.copy()
    starts[1:] |= flags[1:] != flags[:-1]
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(flags)))
    inner = np.zeros(len(first), bool)
    inner[:-1] = ~begins[first[1:]]
    inner &= flags[first] & (size < most) & ~begins[first]
    return np.repeat(inner, size)


def _candidate_windows(w: Words, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows around runs of units that may occur twice."""
    none = np.zeros(0, np.int64), w.hash[:0]
    hashes, whole = w.windows(width)
    if not len(hashes):
        return none
    first, size, digest = w.units("part")
    twice, of = _has(bits, digest), w.of[first]
    same = of[1:] == of[:-1]
    begins, ends = twice.copy(), twice.copy()
    begins[1:] &= ~(twice[:-1] & same)
    ends[:-1] &= ~(twice[1:] & same)
    lo, hi = first[begins], (first + size)[ends]
    long = hi - lo >= LEAST
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, np.maximum(lo[long] - EXTEND, 0), 1)
    np.add.at(change, np.minimum(hi[long] + EXTEND, len(w)), -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
    at = np.flatnonzero(whole & (inside[width:] - inside[: len(hashes)] == width))
    return at, hashes[at]


def _repeated_passages(docs: DataFrame, width: int) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(batches):
        for b in batches:
            parts = [Words(texts).units("part")[2] for _, texts in _blocks(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64))], names=["digest"])
        trim()

    twice = docs.select("text").mapInArrow(digests, "digest bigint").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    column = lambda b: b.column(0).to_numpy().view(np.uint64)
    unit_bits = _bitmap(twice.select("digest"), column)

    def windows(batches):
        bits = unit_bits.value
        for b in batches:
            for lo, texts in _blocks(b.column(1)):
                w = Words(texts)
                at, hashes = _candidate_windows(w, bits, width)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), b.column(0).take(pa.array(lo + w.of[at]))], names=["window", "doc_id"])
        trim()

    each = narrow.mapInArrow(windows, f"window bigint, doc_id {kind}")
    first = written(each.groupBy("window").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "first_doc"))
    window_bits = _bitmap(first.select("window"), column)
    owner_bits = _bitmap(first.filter("first_doc IS NOT NULL"), lambda b: _of_document(column(b), b.column(1)))
    names = ["doc_id", "text_hash", "run", "k", "window", "at", "start", "end", "again"]

    def marks(batches):
        bits, more, owners = unit_bits.value, window_bits.value, owner_bits.value
        for b in batches:
            for lo, texts in _blocks(b.column(1)):
                w = Words(texts)
                at, hashes = _candidate_windows(w, bits, width)
                keep = _has(more, hashes)
                at, hashes = at[keep], hashes[keep]
                if not len(at):
                    continue
                of = w.of[at]
                again = _again(of, hashes, at, width)
                own = _has(owners, _of_document(hashes, b.column(0).take(pa.array(lo + of))))
                begins = np.ones(len(at), bool)
                begins[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
                covered = _within(own, begins, width)
                own &= ~covered
                turns = begins.copy()
                turns[1:] |= (again[1:] != again[:-1]) | (own[1:] != own[:-1])
                mark = turns.copy()  # both sides of every turn, and the windows next to them
                mark[1:] |= turns[:-1]
                mark[:-1] |= turns[1:]
                mark[:-2] |= turns[2:]
                mark[-2:] = True
                mark &= ~covered
                run = (np.cumsum(begins) - 1)[mark]
                at, hashes, of, again = at[mark], hashes[mark], of[mark], again[mark]
                k = np.arange(len(at))
                cols = [b.column(0).take(pa.array(lo + of)), pa.array(_text_hashes(texts)[of])]
                local = at - np.searchsorted(w.of, of)  # the word's number in its own text
                base = local[np.searchsorted(run, run)]  # a run is named by the number of its first word
                cols += [pa.array(base.astype(np.int32)), pa.array((k - np.searchsorted(run, run)).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(local.astype(np.int32))]
                cols += [pa.array((w.start[at] - w.begin[of]).astype(np.int32)), pa.array((w.end[at + width - 1] - w.begin[of]).astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    found = narrow.mapInArrow(marks, f"doc_id {kind}, text_hash bigint, run int, k int, window bigint, at int, start int, end int, again boolean")
    dup = found.join(first, "window").filter("again OR (first_doc IS NOT NULL AND NOT doc_id <=> first_doc)")
    # repeated rows give the same marks again
    text = ["doc_id", "text_hash"]
    dup = dup.groupBy(*text, "run", "k").agg(*[F.min(c).alias(c) for c in ("at", "start", "end", "first_doc")])
    dup = dup.withColumn("island", F.col("k") - F.row_number().over(W.partitionBy(*text, "run").orderBy("k")))
    part = dup.groupBy(*text, "run", "island").agg(F.min("at").alias("lo"), (F.max("at") + width).alias("hi"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"))
    # windows of neighbouring runs can overlap
    order = W.partitionBy(*text).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    part = part.withColumn("new", (before.isNull() | (F.col("lo") > before)).cast("int"))
    part = part.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = part.groupBy(*text, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("hi") - F.min("lo")).cast("long").alias("n_words"), F.min("first_doc").alias("first_doc"))
    return spans.drop("span")


def repeated_spans(docs: DataFrame, min_words: int | None = None, unit: str = "passage") -> DataFrame:
    """``doc_id, text_hash, start, end, n_words, first_doc`` of every span to remove.

    ``unit``: passages (of at least ``min_words`` words, 51 by default), or whole lines or
    paragraphs (runs of at least ``min_words`` words, any by default).
    """
    if unit not in ("passage", "line", "paragraph"):
        raise ValueError(f"unknown unit {unit}")
    small_batches(docs.sparkSession)
    if unit == "passage":
        return _repeated_passages(docs, 51 if min_words is None else min_words)
    return _repeated_units(docs, unit, 1 if min_words is None else min_words)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of their texts, and ``removed`` (with a number after it where ``docs`` has such a column), the original offsets."""
    removed, hashed = free_name(docs, "removed"), free_name(docs, "text_hash")
    grouped = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__removed"))

    def run(batches):
        for b in batches:
            h = _text_hashes(b.column(b.schema.names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h)], names=[*b.schema.names, hashed])

    def clean(batches):
        for b in batches:
            i, j = b.schema.names.index("text"), b.num_columns - 1
            texts = []
            for t, spans in zip(b.column(i).to_pylist(), b.column(j).to_pylist()):
                for s in reversed(spans or ()):
                    t = t[: s["start"]] + t[s["end"] :]
                texts.append(t)
            cols = list(b.columns)
            cols[i] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = docs.mapInArrow(run, f"{kinds}, {hashed} bigint")
    joined = keyed.join(grouped, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed[hashed] == F.col("__h")), "left").select(*[keyed[c] for c in docs.columns], F.col("__removed").alias(removed))
    return joined.mapInArrow(clean, f"{kinds}, {removed} array<struct<start:int,end:int>>")


def op8_passages(spark, sf_dir: str) -> DataFrame:
    """Every repeated span that is removed, with its original offsets."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words", "first_doc")
