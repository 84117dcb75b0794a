import pytest

from sparkloom.llm import decontaminate as D

ITEM = "A train leaves Paris with 120 people and stops after 15 km to let Anna and 30 others out before it goes on"
SHORT = "Why is it"


def run(spark, texts, items=((1, ITEM), (2, SHORT), (3, None), (4, "  ")), **kw):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in D.contaminations(docs, bench, **kw).collect())


FILL = "some words before that mean nothing at all and more"


@pytest.mark.parametrize("shard_rows", [500_000, 3])
def test_cases(spark, shard_rows):
    other = ITEM.replace("120", "77").replace("15 km", "9 miles").replace("Anna", "Berta").replace("30", "41").replace("Paris", "Rome")
    split = ITEM.replace("120", "7").replace("30", "7").replace("15", "7")  # one value for several: still one for each
    texts = [f"{FILL} {ITEM} {FILL}", f"{FILL} {ITEM.upper()}!", f"{FILL}\n{other}, {FILL}", FILL, None, "", "why is it? ", f"{FILL} {ITEM[:40]}", split, "   -  — "]
    assert run(spark, texts, shard_rows=shard_rows) == [(0, 1), (1, 1), (2, 1), (6, 2), (8, 1)]


def test_slots_must_agree(spark):
    item = ((1, "add 5 to 5 and then take 5 from 5 to get 5 back in 5 steps"),)
    assert run(spark, ["add 8 to 8 and then take 8 from 8 to get 8 back in 8 steps"], item) == [(0, 1)]
    assert run(spark, ["add 8 to 1 and then take 2 from 3 to get 4 back in 6 steps"], item) == []


def test_clean_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, ITEM, "x"), (1, FILL, "y"), (1, FILL, "y"), (2, None, "z")], "doc_id long, text string, cover string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in D.contaminations(docs, bench, flag_rows=True).collect()] == [1, 1, 2]
    assert {r.doc_id for r in D.contaminations(docs, bench).collect()} == {None}
    assert D.contaminations(docs.limit(0), bench).count() == 0
    assert D.contaminations(docs, bench.limit(0)).count() == 0


def test_finds_every_verbatim_item(spark):
    import re

    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [plain(r.text or "")] for i, v in items if v in t}
    assert {(r.doc_id, r.item_id) for r in D.contaminations(docs, bench).collect()} == want and want


def test_long_quotes_and_edited_items(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so") for b in ("ba", "de", "fi", "go", "hu", "la", "te", "vo")][:50]
    edited = " ".join("other" if k % 8 == 7 else w for k, w in enumerate(words))
    texts = [" ".join(words[10:30]), edited, " ".join(words[10:22]), " ".join(words[:6] + words[30:36])]
    assert run(spark, [f"{FILL} {t} {FILL}" for t in texts], ((1, " ".join(words)),)) == [(0, 1), (1, 1)]


NAMES = "Anna Peter Mary Tom Laura Omar Ines Paul Greta Hugo Wanda Felix Nora Karl Sofia Emil".split()
TEMPLATES = (
    "{a} has {1} apples. {b} has {2} pears. {c} eats {3} of them. {a} buys {4} plums. How many fruits are left?",
    "{a} drives {1} km in {2} hours. {b} drives {3} km in {4} hours. Who is faster, {a} or {b}?",
    "A shop sells {1} shirts for {2} dollars each. {a} buys {3} of them and pays with {4} dollars. How much money does {a} get back?",
    "{a} reads {1} pages a day. {b} reads twice as many. After {2} days {a} gives {b} {3} books. How many pages did they read?",
    "There are {1} birds on a tree. {2} fly away. {a} counts {3} more. How many birds does {a} see now?",
)


def variant(rnd, template):
    out, people = template, rnd.sample(NAMES, 3)
    for k, name in zip("abc", people):
        out = out.replace("{" + k + "}", name)
    for k, n in zip("1234", rnd.sample(range(2, 900), 4)):
        out = out.replace("{" + k + "}", str(n))
    return out


def test_recall_and_precision_on_variants(spark):
    import random

    rnd = random.Random(6)
    items = [(k, variant(rnd, t)) for k, t in enumerate(TEMPLATES)]
    texts, want = [], set()
    for _ in range(60):
        k = rnd.randrange(len(TEMPLATES))
        want.add((len(texts), k))
        texts.append(f"{FILL} {variant(rnd, TEMPLATES[k])} {FILL}")
    for _ in range(60):  # the same words about other things, in another order
        words = " ".join(items[rnd.randrange(len(items))][1].split(". ")[::-1]).split()
        rnd.shuffle(words)
        texts.append(f"{FILL} {' '.join(words)} {FILL}")
    got = set(run(spark, texts, items))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 1
    assert set(run(spark, texts, items, shard_rows=20)) == got
