import random
from collections import defaultdict

import pytest

from sparkloom.llm import lines as L


def brute(rows, t):
    """Cleaned texts by the definition. rows: (id, text, source)."""
    spread = defaultdict(set), defaultdict(set)
    trim = lambda x: x.strip(L.BLANKS)
    for _, text, source in rows:
        own = [trim(x) for x in (text or "").split("\n") if trim(x)]
        if own:
            content = max((len(x), int(L._hashes([x])[0][0])) for x in own)
            for x in own:
                spread[0][x].add(source)
                spread[1][x].add(content)
    bad = {x for x in spread[0] if len(spread[0][x]) >= t and len(spread[1][x]) >= t}
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        left = [x for x in text.split("\n") if trim(x) not in bad]
        out.append((i, "\n".join(left) if any(map(trim, left)) and len(left) < len(text.split("\n")) else text))
    return out


ROWS = [(i, "\n".join([random.Random(i).choice(["Home | About", " Share this\t", "Cookies", "rare line"]), f"Unique text number {i} of this document", "", random.Random(-i).choice(["Footer", "All rights", f"own {i}"])]), f"s{i % 9}" if i % 10 else None) for i in range(120)]
ROWS += [(200, None, "a"), (201, "", "a"), (202, "Footer", "b"), (203, "Footer\nCookies\n", "b"), (None, "Home | About\nx y z", None)]
ROWS += [(300 + i, "A copied body line that is long enough\nIts second line", f"s{i}") for i in range(9)]
ROWS += [ROWS[0], ROWS[0]]


@pytest.mark.parametrize("shard_rows", [1_000_000, 2])
def test_against_brute_force(spark, shard_rows):
    df = spark.createDataFrame([(*r, 7, "h") for r in ROWS], "doc_id long, text string, source string, n_removed2 int, h1 string")
    boiler = L.boilerplate(df.select("text", "source"))
    got = sorted((str(r.doc_id), str(r.text)) for r in L.remove(df, boiler, shard_rows).collect())
    assert got == sorted((str(i), str(t)) for i, t in brute(ROWS, 5))
    copied = [t for i, t in got if i == "303"]
    assert copied == ["A copied body line that is long enough\nIts second line"]


def test_sketch_and_exact_counts_at_the_threshold(spark):
    rows = [(k * 1000 + i, f"line {k}\nown text {k} {i} is the longest here", f"s{i}") for k in (99, 100, 101) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert L.boilerplate(df, min_sites=100).count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.dedup_lines(df, counts=True).count() == 0


def test_notice_that_is_the_longest_line(spark):
    notice = "This site uses cookies and other means to remember what its visitors have agreed to"
    rows = [(i, f"{notice}\nown text {i}", f"s{i}") for i in range(8)] + [(100 + i, f"{notice} too\nthe same text", f"s{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert all(got[i] == f"own text {i}" for i in range(8)) and all(got[100 + i] == f"{notice} too\nthe same text" for i in range(8))


def test_clashing_columns_and_both_ways(spark):
    rows = [(i, f"Shared footer of all\nown text number {i}", f"s{i}", "a", 5) for i in range(7)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, N_Lines string, n_removed int")
    boiler = L.boilerplate(df.select("text", "source"))
    for most in (1_000_000, 0):
        got = L.remove(df, boiler, most, counts=True)
        assert got.columns == [*df.columns, "n_lines_2", "n_removed_2"]
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"own text number {i}", s, "a", 5, 2, 1) for i, _, s, _, _ in rows + rows[:2])
