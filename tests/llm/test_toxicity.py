import random

import numpy as np

from sparkloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def model(words):
    n = np.zeros(T.SYMBOLS**3, np.int64)
    a = T.stream(" " + " ".join(words) + " ").astype(np.int64)
    np.add.at(n, (a[:-2] << 14) | (a[1:-1] << 7) | a[2:], 1)
    import pandas as pd

    class Rows:
        def toPandas(self):
            at = np.flatnonzero(n)
            return pd.DataFrame({"code": at, "n": n[at]})

    return T.char_model(Rows())


def test_restores(spark):
    m = model(["stupid", "idiot", "loser", "trash", "pathetic", "hello", "world", "moron"] * 50)
    known = T.Restored(m)
    for noisy, clean in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "tr@sh": "trash", "p4th3t1c": "pathetic", "m0r0n": "moron", "hello": "hello", "l o s e r": "loser"}.items():
        assert T.restore(noisy, known) == clean, noisy
    assert T.restore(None, known) == "" and T.restore("   ", known) == ""
    assert len(T.viterbi("a1" * 3000, m)) > 100


def test_char_counts_are_sums(spark):
    texts = ["ab ab", "b!!a", None, "", "éa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.code: r.n for r in T.char_counts(df).collect()}
    assert sum(n for c, n in got.items() if c % 128 == 2 and (c >> 7) % 128 == 1) == 2  # "ab" twice


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    keep = labels.select("doc_id")
    got = T.toxicity(docs.join(keep, "doc_id", "left_semi").select(*docs.columns), labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 5)) == 0).all()
    assert (held.predicted == held.toxic).mean() > 0.96
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.75
    assert held.score.between(0, 1).all()


def test_held_out_labels_are_not_read(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(20)) + (" vilest" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    a = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    b = a.withColumn("toxic", F.expr("IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic)"))
    x = T.toxicity(docs, a).orderBy("doc_id").collect()
    assert x == T.toxicity(docs, b).orderBy("doc_id").collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in x)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x", 1.0), (1, None, 2.0), (1, "", 3.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs, none).collect()
    assert len(got) == 3 and all(r.predicted == 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert T.toxicity(docs.limit(0), none).count() == 0


def test_restores_what_has_few_letters_doubled_letters_or_short_spacing(spark):
    known = T.Restored(model(["shit", "idiot", "ass", "fuck", "letter", "hello", "good", "all"] * 50))
    for noisy, clean in {"5h17": "shit", "1d107": "idiot", "@$$": "ass", "fuuck": "fuck", "a s s": "ass", "s h ! t": "shit", "you a.s.s": "you ass", "letter": "letter", "hello": "hello", "good": "good", "all": "all"}.items():
        assert T.restore(noisy, known) == clean, noisy


def test_viterbi_against_all_paths():
    import itertools
    import random

    import numpy as np

    from sparkloom.llm import toxicity as X

    rnd, rng = random.Random(3), np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(X.SYMBOLS), (X.SYMBOLS, X.SYMBOLS))).astype(np.float32)
    for _ in range(60):
        chunk = "".join(rnd.choice("ab15@!.-xx") * rnd.choice((1, 1, 2, 3)) for _ in range(rnd.randint(1, 5)))
        best = (-np.inf, "")
        for path in itertools.product(*X.lattice(chunk), [(" ", 0.0)]):
            u = v = 0
            score, out = 0.0, []
            for meant, cost in path:
                score -= cost
                for c in meant:
                    z = int(X.ALPHABET[ord(c)])
                    if z == 0 and v == 0:
                        continue  # boundaries are one
                    score += float(model[u, v, z])
                    u, v = v, z
                    out.append(c if z else " ")
            best = max(best, (score, "".join(out).strip()))
        assert X.viterbi(chunk, model) == best[1], chunk


def test_doubled_letters_by_rule_and_by_viterbi():
    import random

    import numpy as np

    from sparkloom.llm import toxicity as X

    rnd, rng = random.Random(4), np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(X.SYMBOLS), (X.SYMBOLS, X.SYMBOLS))).astype(np.float32)
    for _ in range(400):
        word = "".join(rnd.choice("abcdé") * rnd.choice((1, 1, 2, 3)) for _ in range(rnd.randint(1, 7)))
        assert X.doubled(word, memoryview(model.reshape(-1))) == X.viterbi(word + rnd.choice(("", ".", ",")), model), word


def test_restored_chunks_are_those_of_viterbi():
    import random
    import re

    import numpy as np

    from sparkloom.llm import toxicity as X

    rnd, rng = random.Random(5), np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(X.SYMBOLS), (X.SYMBOLS, X.SYMBOLS))).astype(np.float32)
    known = X.Restored(model)
    letters = lambda t: re.findall(r"[^\W\d_]+", t)
    for _ in range(600):
        ends = ["".join(rnd.choice("%#*.,;:?'\"-&)") * rnd.choice((1, 1, 3)) for _ in range(rnd.randint(0, 2))) for _ in range(2)]
        word = "".join(rnd.choice("abcdEé") * rnd.choice((1, 1, 1, 2, 3)) for _ in range(rnd.randint(2, 7)))
        chunk = ends[0] + word + ends[1] + rnd.choice(("", "", "!", "$$$", "1"))
        if chunk.rstrip(".,;:!?").isalpha() and not X.TWICE.search(chunk.lower()):
            continue  # letters without a choice stay as they are, whatever follows
        assert letters(known[chunk]) == letters(X.viterbi(chunk, model)), chunk
