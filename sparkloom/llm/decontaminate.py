"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of outer punctuation. Numbers, units after
numbers, and names (capitalised words inside a sentence, or at its beginning unless
they are among the words that often begin one) become typed placeholders, so a
question with other numbers or names has the same *template*. Windows of ``WIDTH``
template tokens are hashed (an item with fewer tokens is one window), once as
template and once literally, and looked up in the hash table of all benchmark
windows. The lookup is a map-side hash join behind a bitmap of fixed size, so
documents are never shuffled and a passage that many documents share meets no
single task. A benchmark of more than ``shard_rows`` windows (they are counted) is
cut into shards of whole items: one pass over the documents for each, with one
shard in memory, and what it finds is kept beside the documents.

Slots. Windows of one item that match at the same distance are one alignment.
Its slots must agree: a value of the benchmark must always meet the same value of
the document and of the same type. An alignment that does not agree keeps only
its windows without slots. A document is contaminated by an item if windows that
agree are at least ``min_cover`` of the item's windows; or if, in one alignment,
they hold at least ``min_cover`` of its tokens (an edit costs one token, but five
windows) or ``RUN`` consecutive tokens, whatever share of the item that is.

Edge cases: null, empty and wordless texts match nothing, also on the benchmark's
side; null ids are reported as null ids; repeated rows are reported each, repeated
items each; very long texts are worked through whole, in memory some ten times their
size; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import REMEMBERED, cut, small_batches, table, trim, written

WIDTH = 5
#: Consecutive tokens of an item that are a leak however long the item is.
RUN = 13
BITMAP = 1 << 24
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*%?")
QUANTITY = re.compile(r"[+-]?\d[\d.,]*[a-z°µ%]{1,3}")
LINE_END = "\ue000"
UNITS = frozenset("kg g mg t lb lbs oz km m cm mm mi ft in yd l ml dl h hr hrs min mins s sec secs ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles dollar dollars euro euros cent cents percent degrees kmh mph w kw v a hz j pa k c f b kb mb gb tb".split())
#: Words that begin sentences without being names.
BEGINNERS = frozenset("a an the this that these those it he she we you they i there here what which who whom whose when where why how is are was were do does did can could will would should if in on at by for from to of with and or but so as after before during then now each every all some one two many most no not let suppose given find calculate der die das ein eine wie was wer wo wann le la les un une que el los las un una il".split())
OUTER = "\"'`´“”‘’«»„()[]{}<>.,;:!?¡¿…*#&_|~-–—/\\"
NUM, UNIT, NAME, WORD, DROP = 1, 2, 3, 0, 4
_TYPE_HASH = {k: xxhash.xxh64_intdigest(f"<{k}>".encode(), 7) for k in (NUM, UNIT, NAME)}
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH)], np.uint64)


class Words(dict):
    """Raw word -> number of its attributes: literal hash, kind as far as the word tells, capital, ends a sentence."""

    def __init__(self, room: int = 1 << 12):
        super().__init__()
        self.hashes, self.flags = np.zeros(room, np.uint64), np.zeros(room, np.int8)

    def __missing__(self, raw: str) -> int:
        core = "" if raw == LINE_END else raw.strip(OUTER)
        low = core.lower()
        if not low:
            kind = DROP
        elif low.isalpha():
            kind = UNIT if low in UNITS else WORD
        elif NUMBER.fullmatch(low) or QUANTITY.fullmatch(low):
            kind = NUM
        else:
            kind = UNIT if low in UNITS else WORD
        ends = raw == LINE_END or raw[-1] in ".!?:…" or raw.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":", "…")
        i = len(self)
        if i == len(self.hashes):
            self.hashes, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.hashes, self.flags))
        self.hashes[i] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7)
        self.flags[i] = kind | core[:1].isupper() << 3 | ends << 4 | (low in BEGINNERS) << 5
        self[raw] = i
        return i


_KNOWN = Words()


def known_words(bound: int = REMEMBERED) -> Words:
    """This process's memory of words, kept from task to task and emptied when it is full."""
    if len(_KNOWN) > bound:
        _KNOWN.clear()
    return _KNOWN


def canonical(n: np.ndarray, fresh: np.ndarray, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of kept words, their literal hashes, template hashes and types. ``fresh``: a text begins here."""
    h, flags = known.hashes[n], known.flags[n]
    kind, cap, ends, begins = flags & 7, flags & 8 > 0, flags & 16 > 0, flags & 32 > 0
    first = fresh.copy()
    first[1:] |= ends[:-1]
    keep = np.flatnonzero(kind != DROP)
    if not len(keep):
        return keep, h[:0], h[:0], kind[:0]
    # a dropped mark (a dash, a line end) between words may end the sentence too
    starts = np.logical_or.reduceat(first, np.concatenate(([0], keep[:-1] + 1)))
    h, kind, cap, begins = h[keep], kind[keep].copy(), cap[keep], begins[keep]
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == NUM) & ~starts[1:]
    kind[(kind == UNIT) & ~after_number] = WORD
    kind[(kind == WORD) & cap & ~(starts & begins)] = NAME
    template = h.copy()
    for k, x in _TYPE_HASH.items():
        template[kind == k] = x
    return keep, h, template, kind


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
    for k in range(width):
        out += h[k : k + n] * POWERS[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)




def _raw(text: str | None) -> list[str]:
    """Raw words, line ends among them."""
    return (text or "").replace("\n", f" {LINE_END} ").split()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item (number), item_id, pos, n, literal, template, slots`` of every benchmark window."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            for row, t in enumerate(b.column(1).to_pylist()):
                words, known = _raw(t), Words()
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                keep, h, template, types = canonical(n, np.arange(len(n)) == 0, known)
                width = min(WIDTH, len(h))
                if not width:
                    continue
                a, c = window_hashes(h, width), window_hashes(template, width)
                for p in range(len(a)):
                    slots = [f"{p + k}:{types[p + k]}:{words[keep[p + k]].strip(OUTER).lower()}" for k in range(width) if types[p + k] != WORD]
                    for name, v in (("row", row), ("pos", p), ("n", len(a)), ("literal", int(a[p].astype(np.int64))), ("template", int(c[p].astype(np.int64))), ("width", width), ("slots", slots)):
                        out[name].append(v)
            kinds = (("pos", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("literal", pa.int64()), ("template", pa.int64()), ("slots", pa.list_(pa.string())))
            ids = b.column(0).take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[k], t) for k, t in kinds)], names=["item_id", *(k for k, _ in kinds)])

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, pos int, n int, width int, literal bigint, template bigint, slots array<string>")


def contaminations(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.5, shard_rows: int = 500_000, flag_rows: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, cover`` of every contaminated (row, item); with ``flag_rows``, instead the clean rows of ``docs``."""
    small_batches(docs.sparkSession)
    windows = cut(item_windows(benchmark))
    n_shards = max(1, -(-windows.count() // shard_rows))
    out = None
    for s in range(n_shards):  # whole items together, so each shard decides on its own
        part = windows if n_shards == 1 else windows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == s)
        if flag_rows:
            docs = _shard_contaminations(docs, part, benchmark, min_cover, True)
            docs = docs if s == n_shards - 1 else written(docs)
        else:
            found = _shard_contaminations(docs, part, benchmark, min_cover, False)
            out = found if out is None else out.union(found)
    return docs if flag_rows else out


def _shard_contaminations(docs: DataFrame, windows: DataFrame, benchmark: DataFrame, min_cover: float, flag_rows: bool) -> DataFrame:
    """What the items of some benchmark windows, as many as fit in memory, find."""
    sc = docs.sparkSession.sparkContext
    part = windows.toPandas()  # at most about ``shard_rows`` rows: counted by the caller
    widths = sorted(part["width"].unique().tolist())
    keys = np.concatenate((part["literal"].to_numpy(np.int64), part["template"].to_numpy(np.int64))).view(np.uint64)
    src = np.concatenate((np.arange(len(part)), np.arange(len(part))))
    literal = np.repeat([True, False], len(part))
    order = np.argsort(keys, kind="stable")
    bitmap = np.zeros(BITMAP, bool)
    bitmap[(keys >> np.uint64(40)).astype(np.int64)] = True
    items = [(r.item_id, r.pos, r.n, [x.split(":", 2) for x in r.slots]) for r in part.itertuples()]
    shard = sc.broadcast((keys[order], src[order], literal[order], items))
    bits = sc.broadcast(np.packbits(bitmap))
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def quotes(own, n):
        """Whether the windows of one alignment hold enough tokens of an item of n windows, or a long run of them."""
        tokens, run, last = 0, 0, -WIDTH
        for p in sorted(own):
            tokens += min(WIDTH, p - last)
            run = run + 1 if p == last + 1 else 1
            if run + WIDTH - 1 >= RUN:
                return True
            last = p
        return n > 1 and tokens >= min_cover * (n + WIDTH - 1)

    def matches(raw_words, keep, types, hits):
        """(item id, windows, matched) of one text from (position, literal?, item window) hits."""
        aligned = defaultdict(dict)
        for p, literal, (item_id, pos, n, slots) in hits:
            pairs = [] if literal else [(s[1] + s[2], f"{types[p + int(s[0]) - pos]}{raw_words[keep[p + int(s[0]) - pos]].strip(OUTER).lower()}", s[1]) for s in slots]
            aligned[item_id, n, p - pos].setdefault(pos, pairs)
        covered, quoted = defaultdict(set), set()
        for (item_id, n, _), found in aligned.items():
            meets = {}
            agree = all(d[0] == k and meets.setdefault(b, d) == d for pairs in found.values() for b, d, k in pairs)
            own = {pos for pos, pairs in found.items() if agree or not pairs}
            covered[item_id, n] |= own
            if quotes(own, n):
                quoted.add((item_id, n))
        return [(i, n, len(c)) for (i, n), c in covered.items() if len(c) >= min_cover * n or (i, n) in quoted]

    def found(batch):
        """For each row of a batch, its contaminations."""
        out = [[] for _ in range(batch.num_rows)]
        mask = np.unpackbits(bits.value).view(bool)
        texts = batch.column(text_at).to_pylist()
        for lo in range(0, len(texts), 128):
            known = known_words()
            raw = [_raw(t) for t in texts[lo : lo + 128]]
            sizes = np.array([len(w) for w in raw], np.int64)
            begin = np.cumsum(sizes) - sizes
            words = list(chain.from_iterable(raw))
            fresh = np.zeros(len(words), bool)
            fresh[begin[sizes > 0]] = True
            keep, h, template, types = canonical(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), fresh, known)
            doc = np.repeat(np.arange(len(raw)), sizes)[keep]
            where = []
            for width in widths:
                a, c = window_hashes(h, width), window_hashes(template, width)
                inside = doc[: len(a)] == doc[width - 1 : width - 1 + len(a)]
                for x, ok in ((a, inside), (c, inside & (c != a))):
                    p = np.flatnonzero(mask[(x >> np.uint64(40)).astype(np.int64)] & ok)
                    if len(p):
                        where.append((p, x[p]))
            if not where:
                continue
            pos, key = (np.concatenate(x) for x in zip(*where))
            hits = defaultdict(list)
            keys, src, literal, items = shard.value
            a, z = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for k in np.flatnonzero(z > a):
                for j in range(a[k], z[k]):
                    hits[int(doc[pos[k]])].append((int(pos[k]), bool(literal[j]), items[src[j]]))
            for i, x in hits.items():
                out[lo + i] = matches(words, keep, types, sorted(x, key=lambda x: not x[1]))
        return out

    if flag_rows:

        def clean(batches):
            for b in batches:
                yield b.filter(pa.array([not x for x in found(b)], pa.bool_()))
            trim()

        return docs.mapInArrow(clean, docs.schema)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            all_found = [(row, *f) for row, fs in enumerate(found(b)) for f in fs]
            ids = b.column(id_at).take(pa.array([f[0] for f in all_found], pa.int64()))
            cols = [pa.array([f[1] for f in all_found], arrow_item), *(pa.array([f[k] for f in all_found], pa.int64()) for k in (2, 3))]
            cols.append(pa.array([f[3] / f[2] for f in all_found], pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "item_id", "n_windows", "n_matched", "cover"])
        trim()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(benchmark.schema["item_id"].dataType)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, n_windows bigint, n_matched bigint, cover double")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of contaminated documents."""
    return contaminations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
