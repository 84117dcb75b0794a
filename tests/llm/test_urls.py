from sparkloom.llm import urls as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(((h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


URLS = ["http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "http://example.net/fr/", "ftp://example.com/de/a?b#c", "http://org/fr/x", "http://borg/fr/", "http://ÀÉ.org/fr/?a://b", "nothing", "", None, "://", "http://h?x/y", "a://b://c/d", "http://user:p@www.example.com:80/de/", "http://xexample.net/en/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    for r in U.judge(df, none).collect():
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]


def test_mined_rules(spark):
    lab = [(f"http://spam.farm{i % 3}.com/de/buy/{i}?ref=x", True) for i in range(40)] + [(f"http://good{i % 5}.com/de/news/{i}?ref=x", False) for i in range(60)] + [(f"http://good{i % 5}.com/buy/{i}", False) for i in range(40)]
    labelled = spark.createDataFrame(lab, "url string, bad boolean")
    rules = {tuple(r.antecedent): r.confidence for r in U.mine(U.parse(labelled)).collect()}
    assert ("h:spam",) in rules and all(c >= 0.8 for c in rules.values())
    for a in rules:
        assert not any(set(b) < set(a) for b in rules)  # only the most general
        hit = [bad for u, bad in lab if set(a) <= set(brute_tokens(u))]
        assert len(hit) >= 5 and abs(sum(hit) / len(hit) - rules[a]) < 1e-9
    pages = spark.createDataFrame([(1, "http://spam.new.com/x"), (1, "http://spam.new.com/x"), (2, "http://good9.com/buy"), (None, None)], "page_id long, url string")
    got = sorted((str(r.page_id), r.verdict) for r in U.judge(pages, labelled).collect())
    assert got == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "allow")]


def brute_tokens(u):
    host, path, *_ = brute(u)
    q = u.split("?", 1)[1] if "?" in u else ""
    parts = ["s:" + u.split("://")[0]] + ["h:" + x for x in host.split(".")] + ["p:" + x for x in path.replace(".", "/").split("/")] + ["q:" + x.split("=")[0] for x in q.split("&")]
    return [x for x in parts if len(x) > 2 and (x[0] in "hq" or not any(c.isdigit() for c in x))]  # numbers in paths are ids


def test_rules_of_many_tokens_and_query_keys_with_digits(spark):
    five = ["aa", "bb", "cc", "dd", "ee"]
    lab = [(f"http://h.org/{'/'.join(five)}", True)] * 20
    for left in five:  # any four of the five are mostly good
        lab += [(f"http://h.org/{'/'.join(x for x in five if x != left)}", False)] * 10
    rules = [set(r.antecedent) for r in U.mine(U.parse(spark.createDataFrame(lab, "url string, bad boolean"))).collect()]
    assert rules == [{f"p:{x}" for x in five}]
    df = spark.createDataFrame([("http://h.org/x1?utm2=3&b=4",)], "url string")
    assert U.parse(df).first().tokens == ["h:h", "h:org", "q:b", "q:utm2", "s:http"]


def test_hosts_with_digits(spark):
    lab = [(f"http://casino{i % 2}88.example.com/page/x", True) for i in range(30)] + [(f"http://www.example.com/page/x?i={i}", False) for i in range(60)]
    df = spark.createDataFrame([(1, "http://casino088.example.com/other"), (2, "http://www.example.com/other")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(df, spark.createDataFrame(lab, "url string, bad boolean")).collect()}
    assert got == {1: "block", 2: "allow"}


def test_all_rules_are_mined(spark):
    import itertools
    import random

    rnd = random.Random(7)
    rows = []
    for _ in range(150):
        tokens = sorted(rnd.sample("abcdefg", rnd.randint(1, 5)))
        bad = {"a", "b"} <= set(tokens) or {"c", "d", "e"} <= set(tokens) or rnd.random() < 0.15
        rows.append((tokens, bad))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    mined = {tuple(r.antecedent): round(r.confidence, 9) for r in U.mine(df, min_support=0.03, min_count=5, min_confidence=0.8).collect()}
    want = {}
    for k in range(1, 8):
        for s in itertools.combinations("abcdefg", k):
            hit = [bad for t, bad in rows if set(s) <= set(t)]
            if sum(hit) >= 5 and len(hit) and sum(hit) / len(hit) >= 0.8 and not any(set(w) < set(s) for w in want):
                want[s] = round(sum(hit) / len(hit), 9)
    assert mined == want and len(want) > 1
