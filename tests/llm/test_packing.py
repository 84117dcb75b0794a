import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from sparkloom.llm import packing as P

TEXTS = ["Hello, wörld. The END!", None, "", "x " * 5000, "<|endoftext|> a<|startoftext|>b", "don't I'LL 12a345 é é İx ΣΑΣ. ﬁ ŉ, 한 日本 a b c\x1cd\x0be"]


def test_exact_ids_and_places(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "null id", "n"), (0, TEXTS[0], "n")], "doc_id long, text string, length string")
    rows = P.pack(P.pieces(docs)).collect()
    tok = Tokenizer.from_file(P.tokenizer_path())
    want = Counter()
    for i, t in [*enumerate(TEXTS), (None, "null id"), (0, TEXTS[0])]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows)


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_solver_is_near_the_bound():
    rnd = random.Random(3)
    for _ in range(20):
        h = Counter(min(2048, int(rnd.expovariate(1 / 300)) + 1) for _ in range(rnd.randint(1, 3000)))
        plan, bound = P.solve(dict(h), nodes=2000)
        used = Counter()
        for filling, times in plan:
            assert sum(filling) <= 2048 and times > 0
            for s in filling:
                used[s] += times
        assert used == h
        n = sum(k for _, k in plan)
        assert bound <= n <= sum(k for _, k in P.best_fit_decreasing(dict(h), 2048))
        assert n <= -(-sum(s * k for s, k in h.items()) // 2048) * 1.15 + 1


def planted(rnd, bins, capacity=2048):
    """Pieces of full sequences: the optimum is known."""
    h = Counter()
    for _ in range(bins):
        at = sorted(rnd.sample(range(1, capacity), rnd.randint(1, 6)))
        h.update(b - a for a, b in zip([0, *at], [*at, capacity]))
    return dict(h)


def test_planted_optima():
    rnd = random.Random(11)
    for _ in range(60):
        plan, bound = P.solve(planted(rnd, 40))
        assert bound == 40 == sum(k for _, k in plan)


def brute(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            left = list(bins)
            left.remove(room)
            go(i + 1, [*left, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_optimal_on_small_instances():
    rnd = random.Random(2)
    for _ in range(120):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))), reverse=True)
        plan, bound = P.solve(dict(Counter(items)), capacity=20)
        n = sum(k for _, k in plan)
        assert bound <= n == brute(items, 20), items


def test_fillings_around_the_largest():
    assert P.best_filling([3, 4, 7], {3: 2, 4: 1, 7: 1}, 10) == (7, 3)
    assert P.best_filling([3, 4, 5], {3: 2, 4: 1, 5: 1}, 11) == (5, 3, 3)
    found = [f for f, _ in P.undominated([2, 3, 4, 6], {2: 2, 3: 1, 4: 1, 6: 1}, 10, 10)]
    assert found == [(6, 4)]  # 2 + 2 could be 4, 3 could be 4
    assert [f for f, _ in P.undominated([2, 3, 6], {2: 2, 3: 1, 6: 1}, 10, 10)] == [(6, 2, 2), (6, 3)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.pieces(docs)).count() == 0


def test_hot_length(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(3000)], "doc_id long, text string")
    rows = P.pack(P.pieces(docs)).collect()
    per = 2048 // rows[0].length
    assert check_places(rows) == -(-3000 // per)
