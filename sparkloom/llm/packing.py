"""Best-fit packing by bin completion with branch and bound.

Texts are tokenised (byte-pair ids, then id 0 as the end mark); documents longer
than a sequence are cut into full pieces and one rest. Full pieces are sequences
of their own. Rests only matter by their *length*, of which there are fewer than
``capacity`` different ones, so the packing problem is a histogram, whatever the
number of documents: it is counted by Spark, and solved once on the driver.

Solving: bin completion. The largest length left must go somewhere, so fillings
around it are looked for. Totals that the lengths left can make are bit sets, so
the filling that wastes least is found exactly. It is applied as often as the
histogram allows; the result, or best-fit decreasing if that takes fewer sequences,
is the incumbent. If it is above the lower bound (of the total, and of what large
pieces leave for others), its last sequences are solved again by branch and bound:
depth first over sequences, with the undominated fillings around the largest length
as children and the waste that a better solution may have in all as bound.
``nodes`` bounds that search; what is then left between the number of sequences and
the bound is logged. No piece is ever left out.

Placing: each rest gets a rank among the rests of its length. Ranks come from
counts per (length, bucket of the id hash), so a hot length is dealt over many
tasks. The filling table says which slots (sequence, offset) ranks of a length
take; it is a range join against the few rows of that length.

Edge cases: null and empty texts are the end mark alone; null ids and repeated
rows are packed like any other (each row separately); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import logging
import sys
import unicodedata
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import REMEMBERED, cut, small_batches, table, trim

CAPACITY = 2048
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^`{|}~"
LOG = logging.getLogger(__name__)


def tokenizer_path() -> str:
    """The vocabulary file that the contract query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Marks(dict):
    """Marks after a word -> their ids, remembered up to a bound."""

    def __init__(self, ids: Ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, marks: str) -> bytes:
        out = self.ids.bytes(self.ids.encoder.encode(marks, add_special_tokens=False).ids)
        if len(self) >= 10_000:
            self.clear()
        self[marks] = out
        return out


class Ids(dict):
    """Chunk of text without blanks -> its ids as little-endian 32-bit words.

    The tokenizer drops white space and never joins what it separates, so chunks
    between blanks are encoded on their own and remembered, up to a bound. It
    lowers letters and splits them from punctuation, so letters with marks after
    them are put together from their lower-case word and the marks, and words of
    letters go straight to its merge model.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder, self.bound, self.words = Tokenizer.from_file(path), bound, {}
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.merge, self.letters = self.encoder.model.tokenize, _byte_letters()
        self.marks = Marks(self)

    @staticmethod
    def bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or ("\u03a3" not in core and core.lower().isalpha() and unicodedata.is_normalized("NFC", core))):
            word = core.lower()
            ids = self.words.get(word)
            if ids is None:
                ids = self.bytes([t.id for t in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))])
                if len(self.words) >= self.bound:
                    self.words.clear()
                self.words[word] = ids
            if len(core) < len(chunk):
                ids += self.marks[chunk[len(core) :]]
        else:
            ids = self.bytes(self.encoder.encode(chunk, add_special_tokens=False).ids)
        if len(self) >= self.bound:
            self.clear()
        self[chunk] = ids
        return ids


_KNOWN: dict[str, Ids] = {}


def known_ids(path: str) -> Ids:
    """This process's memory of encoded chunks, kept from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = Ids(path)
    return _KNOWN[path]


def chunks_of(text: str | None) -> list[str]:
    """Parts between blanks, line feeds, tabs and carriage returns."""
    return (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, binary) of every piece."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches):
        known = known_ids(path)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "crc", "ids")}
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = b"".join(map(known.__getitem__, chunks_of(t))) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out["at"].append(i)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["crc"].append(zlib.crc32(part))
                    out["ids"].append(part if with_ids else None)
            cols = [b.column(0).take(pa.array(out["at"], pa.int64())), pa.array(out["piece"], pa.int32())]
            cols += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")] + [pa.array(out["ids"], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")
    return out if with_ids else out.drop("ids")


def reaches(sizes: list[int], count: dict[int, int], room: int) -> list[int]:
    """For every number of the smallest ``sizes`` (ascending), a bit set of the totals up to ``room`` that they can make."""
    mask, bits, out = (1 << (room + 1)) - 1, 1, [1]
    for s in sizes:
        if s <= room:
            copies, step = min(count[s], room // s), 1
            while copies:  # copies in powers of two
                k = min(step, copies)
                bits |= (bits << (s * k)) & mask
                copies, step = copies - k, step * 2
        out.append(bits)
    return out


def best_filling(sizes: list[int], count: dict[int, int], capacity: int) -> tuple[int, ...]:
    """The filling around the largest size that wastes least, with larger pieces first where several do."""
    largest = sizes[-1]
    count = {**count, largest: count[largest] - 1}
    reach = reaches(sizes, count, capacity - largest)
    total = reach[-1].bit_length() - 1
    return (largest, *next(_exact(sizes, count, reach, total, len(sizes) - 1)))


def _exact(sizes: list[int], count: dict[int, int], reach: list[int], total: int, top: int):
    """Fillings of exactly ``total`` from the sizes up to number ``top``, larger pieces first."""
    if not total:
        yield ()
        return
    top = min(top, bisect.bisect_right(sizes, total) - 1)
    for i in range(top, -1, -1):
        if not reach[i + 1] >> total & 1:
            return
        s = sizes[i]
        for k in range(min(count[s], total // s), 0, -1):
            if reach[i] >> (total - k * s) & 1:
                for rest in _exact(sizes, count, reach, total - k * s, i - 1):
                    yield (s,) * k + rest


def _spread(bits: int, most: int) -> int:
    """Every set bit moved up by 0 to ``most``."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[int, ...], left: int, waste: int) -> bool:
    """Whether a size of the bit set ``left`` could take the place of some pieces, which would then be free to go elsewhere.

    It must be at least as large as the pieces it replaces (larger than a single one) and
    fit with what is wasted; the filling it makes is at least as good, whatever follows.
    """
    none, one, more = 1, 0, 0
    for s in filling:
        more |= (more << s) | (one << s)
        one |= none << s
    grown = _spread(none | one, waste) & ~(none | one) if waste else 0
    return bool(left & (grown | _spread(more, waste)))


def undominated(sizes: list[int], count: dict[int, int], capacity: int, waste: int):
    """``filling, waste`` around the largest size that waste at most ``waste``: least waste first, no dominated ones."""
    largest = sizes[-1]
    count = {**count, largest: count[largest] - 1}
    room = capacity - largest
    reach = reaches(sizes, count, room)
    for w in range(min(waste, room) + 1):
        if reach[-1] >> (room - w) & 1:
            for f in _exact(sizes, count, reach, room - w, len(sizes) - 1):
                used, left = Counter(f), 0
                for s in sizes:
                    if s > room:
                        break
                    if count[s] > used[s]:
                        left |= 1 << s
                if not dominated(f, left, w):
                    yield (largest, *f), w


def complete_all(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used: the best filling around the largest size, as often as it can be repeated."""
    count = dict(histogram)
    sizes = sorted(count)
    plan = []
    while sizes:
        filling = best_filling(sizes, count, capacity)
        use = Counter(filling)
        times = min(count[s] // k for s, k in use.items())
        plan.append((filling, times))
        for s, k in use.items():
            count[s] -= k * times
            if not count[s]:
                del sizes[bisect.bisect_left(sizes, s)]
    return plan


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the total, and by what large pieces leave for those of at least k (for every k)."""
    size = np.array(sorted(histogram), np.int64)
    if not len(size):
        return 0
    n = np.array([histogram[s] for s in size.tolist()], np.int64)
    total = size * n
    best = -(-int(total.sum()) // capacity)
    half = size > capacity // 2
    for k in [0, *size[~half].tolist()]:
        alone, big, small = size > capacity - k, half & (size <= capacity - k), ~half & (size >= k)
        free = int(n[big].sum()) * capacity - int(total[big].sum())
        best = max(best, int(n[alone | big].sum()) + max(0, -(-(int(total[small].sum()) - free) // capacity)))
    return best


def branch_and_bound(histogram: dict[int, int], capacity: int, incumbent: int, target: int, nodes: int) -> list[tuple[int, ...]] | None:
    """Fewer than ``incumbent`` sequences, if found within ``nodes`` fillings; stops at ``target``.

    Depth first over sequences: each takes the largest size left and one of the
    undominated fillings around it. All sequences together may waste only what an
    incumbent less one leaves over the total, which shrinks with every better solution.
    """
    count, total = dict(histogram), sum(s * n for s, n in histogram.items())
    sizes, path, best = sorted(count), [], None

    def children():
        spare = (incumbent - 1) * capacity - total - sum(w for _, w in path)
        return undominated(sizes, count, capacity, spare) if spare >= 0 else iter(())

    def change(filling, by):
        for s in filling:
            count[s] += by
            at = bisect.bisect_left(sizes, s)
            if not count[s]:
                del sizes[at]
            elif at == len(sizes) or sizes[at] != s:
                sizes.insert(at, s)

    stack = [children()]
    while stack and nodes:
        found = next(stack[-1], None)
        nodes -= 1
        if found is None:
            stack.pop()
            if path:
                change(path.pop()[0], 1)
            continue
        path.append(found)
        change(found[0], -1)
        if sizes:
            stack.append(children())
            continue
        if len(path) < incumbent:
            best, incumbent = [f for f, _ in path], len(path)
            if incumbent <= target:
                return best
        change(path.pop()[0], 1)
    return best


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal lengths go into equal open bins together."""
    open_bins: dict[int, list[list]] = {}  # room -> [filling, number of bins]
    rooms: list[int] = []
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                fit = capacity // size
                filling, times = ((size,) * fit, n // fit) if n >= fit else ((size,) * n, 1)
                used = len(filling) * times
                room = capacity - size * len(filling)
            else:
                room0 = rooms[i]
                entry = open_bins[room0][-1]
                times = min(entry[1], n)
                entry[1] -= times
                filling, used, room = (*entry[0], size), times, room0 - size
                if not entry[1]:
                    open_bins[room0].pop()
                    if not open_bins[room0]:
                        del open_bins[room0], rooms[i]
            n -= used
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append([filling, times])
    return [(f, k) for b in open_bins.values() for f, k in b]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000, tails: tuple[int, ...] = (20, 60, 180)) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """The plan with the fewest sequences found, and how many any packing needs.

    Best fit and repeated best fillings give the incumbent. While it is above the
    bound, its last sequences (more and more of them) are solved again by branch and bound.
    """
    plans = [complete_all(histogram, capacity), best_fit_decreasing(histogram, capacity)]
    plan, bound = min(plans, key=lambda p: sum(k for _, k in p)), lower_bound(histogram, capacity)
    for tail in tails:
        n = sum(k for _, k in plan)
        if n <= bound:
            break
        head, rest = list(plan), []
        while head and len(rest) < tail:
            filling, times = head.pop()
            take = min(times, tail - len(rest))
            rest += [filling] * take
            if times > take:
                head.append((filling, times - take))
        done = n - len(rest)
        again = branch_and_bound(Counter(s for f in rest for s in f), capacity, len(rest), max(0, bound - done), nodes)
        if again is not None:
            plan = head + [(f, 1) for f in again]
        if not head:
            break
    return plan, bound


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, last rank, first sequence, offset``: rank first + i sits in sequence first + i."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for size in filling:
            out.append((size, rank[size], rank[size] + times - 1, sequence, offset))
            rank[size] += times
            offset += size
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``."""
    spark = parts.sparkSession
    parts = cut(parts)
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan, bound = solve(histogram, capacity, nodes)
    LOG.info("%d sequences, at least %d are needed", sum(k for _, k in plan), bound)
    where = slots(plan)
    buckets = max(64, sum(histogram.values()) // 1_000_000)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    firsts: dict[int, tuple[list[int], list[int], list[int]]] = {}
    for size, lo, _, seq, off in where:
        a, b, c = firsts.setdefault(size, ([], [], []))
        a.append(lo), b.append(seq), c.append(off)
    held = spark.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in v) for k, v in firsts.items()})  # at most (fillings x pieces of one) rows, bounded by `capacity`

    def place(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                lo, first, offset = held.value[int(s)]
                i = np.searchsorted(lo, rank[own], "right") - 1
                seq[own], off[own] = first[i] + rank[own] - lo[i], offset[i]
            keep = b.select([n for n in b.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(off)], names=[*keep.schema.names, "sequence_id", "offset"])

    cols = parts.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*cols, "rank").mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: where every piece of every document is placed."""
    return pack(pieces(table(spark, sf_dir, "documents")))
