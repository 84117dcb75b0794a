import random

from sparkloom.llm import substring as B


def words(rnd, n):
    out = []
    for k in range(n):
        w = "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
        out.append((w.capitalize() if k == 0 or out[-1].endswith(".") else w) + ("." if rnd.random() < 0.12 or k == n - 1 else ""))
    return " ".join(out)


def test_planted_passages(spark):
    rnd = random.Random(9)
    passages = [words(rnd, n) for n in (55, 90, 200)]
    docs, where = [], {}
    for i in range(60):
        a, b = words(rnd, 60)[:-1], words(rnd, 40)
        if i % 4 == 0:
            p = passages[i // 4 % 3]
            docs.append((i, f"{a} {p} {b.lower()}"))
            where[i] = (len(a) + 1, len(a) + 1 + len(p), i // 4 % 3)
        else:
            docs.append((i, f"{a}. {b}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = B.repeated_spans(df).collect()
    first = {k: min(i for i, w in where.items() if w[2] == k) for k in range(3)}
    assert {s.doc_id for s in spans} == {i for i, w in where.items() if i != first[w[2]]}
    for s in spans:
        lo, hi, k = where[s.doc_id]
        assert s.first_doc == first[k] and abs(s.start - lo) < 40 and abs(s.end - hi) < 40
        assert dict(docs)[s.doc_id][s.start : s.end] in passages[k]
    clean = {r.doc_id: r.text for r in B.remove_spans(df, B.repeated_spans(df)).collect()}
    assert len(clean) == 60
    for i, t in docs:
        s = [x for x in spans if x.doc_id == i]
        assert clean[i] == (t[: s[0].start] + t[s[0].end :] if s else t)


def test_copies_repeats_and_edges(spark):
    rnd = random.Random(1)
    text = words(rnd, 80)
    long = words(rnd, 70)
    rows = [(5, text, 1), (9, text, 1), (9, text, 1), (None, text, 1), (2, None, 1), (3, "", 1), (4, "short. text.", 1), (6, "short. text.", 1), (7, f"{long} {long}", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    spans = {(s.doc_id, s.start, s.end) for s in B.repeated_spans(df).collect()}
    assert spans == {(9, 0, len(text)), (None, 0, len(text)), (7, len(long) + 1, 2 * len(long) + 1)}
    assert B.repeated_spans(df.limit(0)).count() == 0


def test_offsets_are_original():
    t = "  One  two three.\n\nFour FIVE. six"
    for digest, lo, hi, n in B.units(t):
        assert t[lo:hi] == t[lo:hi].strip() and len(t[lo:hi].split()) == n
    assert " ".join(" ".join(t[lo:hi].split()) for _, lo, hi, _ in B.units(t)) == " ".join(t.split())


def test_lines_and_paragraphs(spark):
    a, b, c = "The first line, of a few words.", "a  SECOND line", "third"
    docs = [(1, f"{a}\n{b}\n\n{c}\n", "x"), (2, f"own\n{b.lower()}\n\n{a}\n{b}\n \n{c}", "x"), (3, f"{c}\n{c}\nnew", "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, removed string")
    text = {i: t for i, t, _ in docs}
    for unit, want in (("line", {(2, text[2][4:]), (3, f"{c}\n{c}")}), ("paragraph", {(2, f"{a}\n{b}\n \n{c}")})):
        spans = B.repeated_spans(df, unit=unit)
        assert {(s.doc_id, text[s.doc_id][s.start : s.end]) for s in spans.collect()} == want
        clean = B.remove_spans(df, spans)
        assert clean.columns == [*df.columns, "removed_2"] and clean.count() == 5


def brute(rows, width):
    """Character positions to remove, by the definition: windows of ``width`` words that an earlier id, or the own text a window before, has."""
    ranked = sorted({(i is None, i, t) for i, t in rows if t}, key=lambda x: (x[0], x[1] or 0))
    first, out = {}, {}
    spans = {}
    for none, i, t in ranked:
        at, pos = [], 0
        for w in t.split():
            pos = t.index(w, pos)
            at.append((pos, pos + len(w)))
            pos += len(w)
        low = t.lower().split()
        spans[none, i, t] = [(tuple(low[k : k + width]), k, at[k][0], at[k + width - 1][1]) for k in range(len(low) - width + 1)]
        for w, *_ in spans[none, i, t]:
            if not none:
                first.setdefault(w, i)
    for key, found in spans.items():
        none, i, t = key
        seen, gone = {}, set()
        for w, k, a, b in found:
            again = k - seen.setdefault(w, k) >= width
            if again or (w in first and (none or first[w] != i)):
                gone |= set(range(a, b))
        out[i, t] = gone
    return out


def test_passages_against_brute_force(spark):
    rnd = random.Random(12)
    passages = [words(rnd, n) for n in (51, 52, 60, 75, 120, 51, 53)]
    rows = []
    for i in range(70):
        parts = [words(rnd, rnd.randint(3, 60)) for _ in range(3)]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, 3), p if rnd.random() < 0.7 else p.upper())
        if rnd.random() < 0.3:
            parts.insert(1, " ".join(passages[3].split()[: rnd.choice((45, 50, 51, 55))]))  # too short, or just enough
        rows.append((i if i % 11 else None, rnd.choice((" ", "\n", "  ")).join(parts)))
    rows += [rows[3], rows[3], (90, "Er " * 300), (91, "er " * 200 + "tail"), (92, rows[5][1] + " more"), (3, passages[0]), (93, "İstanbul " + passages[2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    want = brute(rows, 51)
    texts = {}
    for i, t in rows:
        texts.setdefault((i, int(B._text_hashes([t])[0])), t)
    got = {(i, t): set() for i, t in want}
    spans = B.repeated_spans(df).collect()
    assert len(spans) == len({(s.doc_id, s.text_hash, s.start) for s in spans})
    for s in spans:
        t = texts[s.doc_id, s.text_hash]
        assert s.n_words == len(t[s.start : s.end].split()) >= 51
        got[s.doc_id, t] |= set(range(s.start, s.end))
    blank = lambda k, gone: {c for c in gone if not k[1][c].isspace()}
    assert sum(map(len, want.values())) > 5000
    assert {k: blank(k, v) for k, v in got.items()} == {k: blank(k, v) for k, v in want.items()}
