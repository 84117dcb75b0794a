import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import kneser_ney as K

SF = "/root/testdata/sf0.001"
EOS = "<end>"


def symbols(text):
    """Words; a repeated one as (place in its run,); then the end."""
    out, run = [], 1
    words = (text or "").split()
    for i, w in enumerate(words):
        run = run + 1 if i and w == words[i - 1] else 1
        out.append((run,) if run > 1 else w)
    return [*out, EOS] if words else []


def brute(texts, chars):
    """The model by the textbook, on dictionaries: ln p(w | v), given what is left out."""
    c2 = Counter()
    for t in texts:
        s = symbols(t)
        c2.update(zip([EOS, *s], s))
    context = defaultdict(Counter)
    for (v, w), n in c2.items():
        context[v][w] = n
    c1 = Counter(w for _, w in c2)
    counts = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
    d2, d1 = K.discounts(counts(c2)), K.discounts(counts(c1))
    cut = lambda n, d: n - d[min(n, 3) - 1] if n > 1 else 0.0
    total1 = max(sum(c1.values()), 1)
    rest = 1 - sum(cut(n, d1) for n in c1.values()) / total1 if c1 else 1.0

    def p(v, w, p0, out=Counter(), total_out=Counter(), alone=Counter()):
        n, c, k = c2[v, w] - out[v, w], sum(context[v].values()) - total_out[v], c1[w] - alone[w]
        low = cut(k, d1) / total1 + rest * p0
        b = 1 - sum(cut(x, d2) for x in context[v].values()) / max(sum(context[v].values()), 1)
        return (cut(n, d2) / c if c > 0 else 0.0) + (b if c > 0 else 1.0) * low

    return p, c2


def spellings(text, chars, distinct_pairs):
    """ln p of every event's spelling."""
    out = []
    for word, symbol in zip((text or "").split(), symbols(text)):
        raw = word.encode()
        a = [0, 0, *K.CLASS[list(raw)], 0]
        p = sum(chars[(int(a[i]) << 12) | (int(a[i + 1]) << 6) | int(a[i + 2])] for i in range(len(raw) + 1)) + sum(K.SHARE[b] for b in raw)
        out.append(p - (math.log(distinct_pairs) if symbol != word else 0))
    return [*out, chars[0]]


TEXTS = ["the cat sat on the mat .", "the dog sat on the log .", "a cat and a dog , the End", "the the the cat cat", None, "", " \t\n", "the cat sat on the mat . the cat", "Ähm the dog", "the dog"]


@pytest.mark.parametrize("limit", [8_000_000, 0])
@pytest.mark.parametrize("own", [False, True])
def test_against_the_textbook(spark, limit, own):
    m = K.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    p, c2 = brute(TEXTS, m.chars)
    tests = TEXTS if own else ["the cat sat", "dog dog dog dog", "unseen WORDS here", "the", None, "  ", "the cat sat on the mat ."]
    df = spark.createDataFrame(list(enumerate(tests)), "i int, text string")
    got = {r.i: r for r in K.score(df, m, ["i"], own, limit).collect()}
    assert len(got) == len(tests)
    for i, t in enumerate(tests):
        s = symbols(t)
        assert got[i].n_words == max(len(s) - 1, 0)
        if not s:
            assert got[i].log_ppl is None
            continue
        pairs = list(zip([EOS, *s], s))
        out = Counter(pairs) if own else Counter()
        alone = Counter(w for (v, w), n in out.items() if c2[v, w] == n)
        each = [p(v, w, math.exp(q), out, Counter(v for v, _ in pairs) if own else Counter(), alone) for (v, w), q in zip(pairs, spellings(t, m.chars, len(c2)))]
        assert abs(got[i].log_ppl + np.mean(np.log(each))) < 1e-5, t


def test_probabilities_sum_to_one(spark):
    m = K.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    p, c2 = brute(TEXTS, m.chars)
    words = {w for _, w in c2}
    for v in ("the", EOS, "unseen"):  # without spellings: the mass that is left is theirs
        known = sum(p(v, w, 0.0) for w in words)
        left = p(v, "nothing", 1.0)
        assert abs(known + left - 1) < 1e-9
    n = m.chars.reshape(64, 64, 64)
    assert np.allclose(np.exp(n).sum(2), 1)


def test_blocks_and_very_long_texts_change_nothing():
    rnd = random.Random(5)
    vocabulary = ["a", "bb", "ccc", "dé", "x" * 70, "end."]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", " ", "\n\n"]) for _ in range(40)] + [None, "", "bb bb  bb bb bb bb", "z" * 300]
    column = pa.array(texts)

    def flat(block):
        out = []
        for texts, before, symbol, end_text, end_before, _ in K.events(column, block):
            out += list(zip(texts.tolist(), before.tolist(), symbol.tolist())) + [(t, v, 0) for t, v in zip(end_text.tolist(), end_before.tolist())]
        return Counter(out)

    whole = flat(1 << 20)
    assert all(flat(block) == whole for block in (1, 7, 64, 500))
    assert sum(whole.values()) == sum(len(symbols(t)) for t in texts)
    assert K.string_bytes(column.slice(3, 5))[1][0] == K.string_bytes(column)[1][3]


def test_quality_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = K.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 0].keep.mean() < 0.1
    assert got[got.quality == 1].keep.mean() > 0.95
    kept = {r.doc_id for r in K.keep_documents(docs, labels).collect()}
    assert kept == {r.doc_id for r in K.classify(docs, labels).filter("keep").collect()}
    assert kept == {r.doc_id for r in K.keep_documents(docs, labels, resident_rows=0).collect()}


def test_garbled_words_cost_more(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = K.train(K.trusted_documents(docs, labels))
    rnd = random.Random(2)
    good = [r.text for r in docs.join(labels.filter("quality = 1"), "doc_id").limit(20).collect()]
    often = {w for w, _ in Counter(w for t in good for w in t.split()).most_common(100)}
    garbled = [" ".join(w if w in often else "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in t.split()) for t in good]
    a, b = ([r.log_ppl for r in K.score(spark.createDataFrame([(t,) for t in x], "text string"), m, []).collect()] for x in (good, garbled))
    assert np.mean(b) > np.mean(a) + 1


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (2, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b c", "en", 1), (2, None, None, 2), (None, "x y", "xx", 3), (1, "", "en", 4), (1, "a b c", "en", 1)], "doc_id long, text string, lang string, threshold int")
    for limit in (8_000_000, 0):
        got = K.classify(docs, labels, resident_rows=limit).collect()
        assert len(got) == 5 and sum(r.log_ppl is None for r in got) == 2 and not any(r.keep for r in got if r.log_ppl is None)
        assert sum(r.doc_id == 1 and r.keep for r in got) == 2
        kept = K.keep_documents(docs, labels.limit(0), resident_rows=limit)
        assert kept.count() == 3 and kept.columns == docs.columns
    assert K.classify(docs.limit(0), labels).count() == 0


def test_joined_way_shuffles_nothing_of_the_row_or_its_words(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, lang string")
    m = K.train(docs)
    e = K.text_events(docs.select("text"), m.chars, m.once)
    assert [(f.name, f.dataType.simpleString()) for f in e.schema] == [("text_hash", "bigint"), ("code", "bigint"), ("m", "int"), ("mc", "int"), ("lp", "float")]
    for own in (False, True):
        ways = [K._scores_joined(docs, m, ["doc_id", "lang"], own, small) for small in (1_000_000, 0)] + [K.score(docs, m, ["doc_id", "lang"], own)]
        a, b, c = ([(r.doc_id, r.lang, r.n_words, r.log_ppl and round(r.log_ppl, 4)) for r in sorted(w.collect(), key=lambda r: r.doc_id)] for w in ways)
        assert a == b == c and len(a) == len(TEXTS) + 1


def whole_textbook(texts):
    """ln p(w | v) of interpolated modified Kneser-Ney with all three discounts and nothing cut off, on dictionaries."""
    c2 = Counter(p for t in texts for p in zip([EOS, *symbols(t)], symbols(t)))
    context = defaultdict(Counter)
    for (v, w), n in c2.items():
        context[v][w] = n
    c1 = Counter(w for _, w in c2)

    def three(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y, 0), k) for k in (1, 2, 3)]

    d2, d1 = three(c2), three(c1)
    off = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    free = sum(off(n, d1) for n in c1.values()) / len(c2)

    def p(v, w, p0, out=Counter(), alone=Counter()):
        k, n = c1[w] - alone[w], c2[v, w] - out[v, w]
        low = (k - off(k, d1)) / len(c2) + free * p0
        seen = sum(context[v].values())
        c = seen - sum(m for (a, _), m in out.items() if a == v)
        if c <= 0:
            return low
        return (n - off(n, d2)) / c + sum(off(x, d2) for x in context[v].values()) / seen * low

    return p, c2, {v for v, row in context.items() if set(row.values()) == {1}}


@pytest.mark.parametrize("limit", [8_000_000, "parts", 0])
def test_classifier_keeps_pairs_and_words_seen_once(spark, limit):
    texts = [*TEXTS, "a bird sang on the log", "the cat saw a bird , the End"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    m = K.train(docs, whole=True)
    parts = {8_000_000: 1, "parts": 2, 0: 0}[limit]
    limit = m.n_words + -(-m.n_pairs // 2) if limit == "parts" else limit
    assert m.parts(limit) == parts
    p, c2, _ = whole_textbook(texts)
    assert {n for n in c2.values()} >= {1, 2, 3}
    assert m.n_pairs == len(c2) and m.n_words == len({w for _, w in c2})
    of_classify = {r.doc_id: r.log_ppl for r in K.classify(docs, labels, resident_rows=limit).collect()}
    left_out = {r.doc_id: r.log_ppl for r in K.score(docs, m, ["doc_id"], True, limit).collect()}
    kept = {r.doc_id for r in K.keep_documents(docs, labels, resident_rows=limit).collect()}
    assert kept == {r.doc_id for r in K.classify(docs, labels).filter("keep").collect()}
    for i, t in enumerate(texts):
        s = symbols(t)
        if not s:
            assert of_classify[i] is None and left_out[i] is None
            continue
        pairs = list(zip([EOS, *s], s))
        spelt = [math.exp(q) for q in spellings(t, m.chars, len(c2))]
        own = Counter(pairs)
        alone = Counter(w for (v, w), n in own.items() if c2[v, w] == n)
        assert abs(of_classify[i] + np.mean([math.log(p(v, w, q)) for (v, w), q in zip(pairs, spelt)])) < 1e-5, t
        assert abs(left_out[i] + np.mean([math.log(p(v, w, q, own, alone)) for (v, w), q in zip(pairs, spelt)])) < 1e-5, t


def test_whole_probabilities_sum_to_one():
    p, c2, once = whole_textbook(TEXTS)
    assert once  # contexts that a model without pairs seen once knows nothing about
    for v in {v for v, _ in c2} | {"unseen"}:
        assert abs(sum(p(v, w, 0.0) for w in {w for _, w in c2}) + p(v, "nothing", 1.0) - 1) < 1e-9


def test_passes_score_as_one_does(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.unionAll(docs.limit(5)).unionAll(docs.limit(1).selectExpr("CAST(null AS bigint) doc_id", "text", "lang", "source", "n_chars"))
    m = K.train(K.trusted_documents(docs, labels), whole=True)
    rows = m.n_words + -(-m.n_pairs // 3)
    assert m.parts(rows) == 3
    of = [K.classify(docs, labels, resident_rows=r).selectExpr("doc_id", "lang", "n_words", "round(log_ppl, 6) log_ppl", "round(threshold, 6) threshold", "keep") for r in (8_000_000, rows)]
    a, b = (sorted(map(str, x.collect())) for x in of)
    assert a == b and len(a) == docs.count()
    same = lambda x: sorted(map(str, x.collect()))
    kept = [same(K.keep_documents(docs, labels, resident_rows=r, small=s)) for r, s in ((8_000_000, 1), (rows, 1_000_000), (rows, 0))]
    assert kept[0] == kept[1] == kept[2]


class Counted(np.ndarray):
    """A table that notes how many entries were looked up."""

    seen = 0

    def __getitem__(self, at):
        if isinstance(at, np.ndarray):
            Counted.seen += at.size
        return np.asarray(self)[at]


def resident_parts(texts, parts):
    """The whole model of ``texts`` in parts, without Spark."""
    c2 = Counter()
    for _, before, symbol, _, end_before, _ in K.events(pa.array(texts)):
        c2.update(((before << 32) | symbol).tolist() + (end_before << 32).tolist())
    code, n = np.array(sorted(c2)), np.array([c2[x] for x in sorted(c2)], np.int32)
    symbols = np.unique(code & 0xFFFFFFFF)
    at = np.searchsorted(symbols, code & 0xFFFFFFFF)
    c, k = (np.bincount(at, w).astype(np.int32) for w in (n, None))
    chars = np.log(np.random.default_rng(1).random(K.KINDS**3)).view(Counted)

    def by_key(key, *columns):
        order = np.argsort(K._mixed(key))
        return (K._mixed(key)[order], *[x[order] for x in columns])

    for part in range(parts):
        here = (code & 0xFFFFFFFF) % parts == part
        yield K.Resident(*by_key(code[here], n[here]), *by_key(symbols, c, np.full(len(c), 0.3, np.float32), k), chars, (0.5, 0.9, 1.2, 0.5, 0.9, 1.2, len(code), 0.1), part, parts)


def test_parts_spell_their_own_words_only(monkeypatch):
    texts = [*TEXTS, "a b a" + " " * 90 + "a b a c", "unseen words of many letters"]
    column = pa.array(texts)
    spelt = sum(len("".join(t.split()).encode()) + len(t.split()) for t in texts if t)
    for own in (False, True):
        means = {}
        for parts in (1, 3):
            Counted.seen = 0
            n, means[parts] = (sum(x) for x in zip(*[K.column_scores(column, held, own) for held in resident_parts(texts[:-1], parts)]))
            assert (n == parts * np.array([len(symbols(t)) for t in texts])).all()
            assert Counted.seen == spelt  # the bytes and the end of every word, in one part only
        assert np.allclose(means[1], means[3])
        with monkeypatch.context() as patch:  # a blank longer than a block does not end a text
            patch.setattr(K, "BLOCK", 16)
            for parts in (1, 3):
                assert np.allclose(sum(K.column_scores(column, held, own)[1] for held in resident_parts(texts[:-1], parts)), means[1])


def test_single_words_follow_from_the_pairs_where_all_are_kept(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    with_singles, pairs = (K.count_events(docs, s).filter("kind = 0").collect() for s in (True, False))
    follow = Counter()
    for r in pairs:
        assert r.code >> 32 != K.WORD
        follow[K.WORD << 32 | r.code & 0xFFFFFFFF] += r.n
        follow[K.WORD << 32 | K.EVENTS] += r.n
    assert follow == {r.code: r.n for r in with_singles if r.code >> 32 == K.WORD}


def test_chunks_ask_for_their_rows_of_the_model(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.unionAll(docs.limit(5)).unionAll(docs.limit(2).selectExpr("CAST(null AS bigint) doc_id", "if(doc_id % 2 = 0, null, text) text", "null lang", "source", "n_chars"))
    for name, value in (("CHUNK", 9_000), ("BUCKET", 4_000), ("BLOCK", 5_000)):
        monkeypatch.setattr(K, name, value)
    trusted = K.trusted_documents(docs, labels)
    m = K.train(trusted, whole=True)
    rows = lambda df: sorted(str((r.doc_id, r.lang, r.n_words, r.log_ppl and round(r.log_ppl, 5))) for r in df.collect())
    jobs = [(trusted, ["doc_id", "lang"], True), (docs, ["doc_id", "lang"], False)]
    for got, (texts, columns, own) in zip(K._scores_asked(m, *jobs), jobs):
        assert rows(got) == rows(K.score(texts, m, columns, own))
    ways = [sorted(map(str, K.classify(docs, labels, resident_rows=r).selectExpr("doc_id", "lang", "n_words", "round(log_ppl, 5)", "round(threshold, 5)", "keep").collect())) for r in (8_000_000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == docs.count()
    keys = np.sort(K._mixed(np.arange(-50, 900, 7)))
    assert (K._unpacked(K._packed(keys)) == keys).all() and len(K._unpacked(b"")) == 0
