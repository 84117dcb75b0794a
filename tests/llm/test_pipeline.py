import re

import corpus_pipeline as P
from sparkloom.llm import registry
from tests.llm.test_packing import check_places
from tests.oracle import SF, connect, rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, bench = docs.collect(), [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == docs.columns
            ids = {r.doc_id for r in after.collect()}
            assert ids <= {r.doc_id for r in before}
        if name == "quality classifier":
            assert all(labels.get(i, 1) for i in ids)
            assert sum(labels.get(r.doc_id) == 1 for r in before) - sum(labels.get(i) == 1 for i in ids) <= 2
        if name == "near dedup":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts)) < len(before)
        if name == "decontamination":
            left = [" ".join(re.findall(r"\w+", r.text.lower())) for r in after.collect()]
            assert not any(" ".join(b) in t for b in bench for t in left)
        docs, before = after, after.collect()
    assert check_places(before) > 0


def test_oracles(spark):
    c = connect()
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, SF).toPandas(), c.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want), name


def test_registered():
    names = list(registry.queries())
    assert names[0] == "pipeline" and [int(n[2:].split("_")[0]) for n in names[1:]] == list(range(1, 11))


def _folder(spark, tmp_path, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_Removed int, text_hash string, h1 string, key string, cover double"


def test_edges_of_every_stage(spark, tmp_path):
    import random

    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice("the of and river stone walks under bridge slowly night morning".split()) for _ in range(n))
    item = "A train leaves Paris with 120 people and stops after 15 km to let Anna and 30 others out"
    texts = [prose(60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 7}", len(t), 1, "x", "y", "z", 0.5) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " tail", None, None, None, None, None, None, None, None), (None, prose(50), "en", None, 5, None, None, None, None, None)]
    rows += [rows[3], rows[3], (7, prose(45), "en", "s", 9, 1, "x", "y", "z", 0.5), (80, None, "en", "s", 0, 1, "x", "y", "z", 0.5), (81, "", "en", "s", 0, 1, "x", "y", "z", 0.5), (82, prose(20_000), "en", "s", 9, 1, "x", "y", "z", 0.5), (83, f"{prose(30)} {item}", "en", "s", 9, 1, "x", "y", "z", 0.5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (80, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    sf = _folder(spark, tmp_path / "full", docs, labels, bench)
    want = {"quality classifier": None, "line dedup": len(rows), "near dedup": None, "decontamination": len(rows) - 1}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert sorted(c for c in out.columns if c in ("doc_id", "piece", "sequence_id", "offset")) == ["doc_id", "offset", "piece", "sequence_id"]
            assert check_places(out.collect()) > 0
            continue
        got = out.collect()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if want[name]:
            assert len(got) == want[name], name
        if name == "near dedup":
            distinct = {(r[0], r[1]) for r in rows}
            gone = [k for k in distinct if k not in {(r.doc_id, r.text) for r in got}]
            assert len(got) == len(distinct) - len(gone) and len([r for r in got if r.doc_id == 7]) == 2
            assert set(gone) <= {(None, texts[0] + " tail"), (81, "")}  # a near copy and the second text without words
        if name == "quality classifier":
            assert not any(r.doc_id in (80, 81) for r in got) and sum(r.doc_id == 3 for r in got) == 3
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0, name
    none = _folder(spark, tmp_path / "none", docs.limit(0), labels.limit(0), bench.limit(0))
    assert P.run(spark, none).count() == 0
