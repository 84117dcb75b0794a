"""URL filters by association rules.

Tokens of a URL are its scheme, host labels, path words without digits (those are
ids) and query keys. From URLs with a label, Spark's FP-growth mines frequent token sets with
the label as one more item. A rule "tokens -> block" is kept if its support and
confidence suffice and no kept rule uses a subset of its tokens. Rules match by
an inverted index: each is filed under its rarest token, a URL looks up its
tokens, and the rule applies if the URL has all of its tokens. Matching works on
distinct token sets, so that hot hosts are looked up once.

Stated rules (host, path) come first: a rule fits its host and all subdomains if
the path starts with the rule's; the longest wins.

Edge cases: null URLs and those without ``://`` have an empty host and path and
no tokens: allowed unless a stated rule fits; repeated rows are judged each; null
ids pass through; with no labelled URL nothing is mined; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path`` and ``tokens``."""
    url = F.col(url_col)
    cut_at = F.instr(url, "://")
    rest = F.when(cut_at > 0, F.substring(url, cut_at + 3, F.length(url))).otherwise(F.lit(""))
    out = urls.withColumn("__rest", F.coalesce(rest, F.lit("")))
    raw_host = F.regexp_extract("__rest", r"^([^/?#]*)", 1)
    out = out.withColumn("host", F.translate(raw_host, UPPER, LOWER))
    out = out.withColumn("path", F.regexp_extract(F.substring("__rest", F.length("host") + 1, F.length("__rest")), r"^([^?#]*)", 1))
    words = lambda c, by, tag, ids=True: F.transform(F.filter(F.split(c, by), lambda x: (x != "") & (~x.rlike("[0-9]") if ids else F.lit(True))), lambda x: F.concat(F.lit(tag), F.lower(x)))
    keys = words(F.regexp_replace(F.regexp_extract("__rest", r"\?([^#]*)", 1), "=[^&]*", ""), "&", "q:", ids=False)
    scheme = F.when(F.col("__rest") != "", F.array(F.concat(F.lit("s:"), F.lower(F.substring(url, F.lit(1), cut_at - 1))))).otherwise(F.array().cast("array<string>"))
    tokens = F.array_sort(F.array_distinct(F.concat(scheme, words("host", r"\.", "h:", ids=False), words("path", "[/._-]", "p:"), keys)))
    return out.withColumn("tokens", tokens).drop("__rest")


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """``antecedent, key, confidence`` of the rules mined from ``tokens, bad`` (boolean)."""
    spark = labelled.sparkSession
    baskets = cut(labelled.filter("bad IS NOT NULL AND size(tokens) > 0").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    empty = spark.createDataFrame([], "antecedent array<string>, key string, confidence double")
    if not n:
        return empty
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n))).fit(baskets).freqItemsets
    sets = cut(sets.select(F.array_sort("items").alias("items"), "freq"))
    with_block = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("antecedent"), F.col("freq").alias("both"))
    whole = sets.filter(~F.array_contains("items", BLOCK)).select(F.col("items").alias("antecedent"), "freq")
    rules = with_block.join(whole, "antecedent").withColumn("confidence", F.col("both") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    rules = cut(rules.select("antecedent", "confidence"))
    # keep the most general: a rule goes if a rule of some of its tokens exists; that rule shares a token with it
    part = rules.select(F.col("antecedent").alias("small"), F.explode("antecedent").alias("t"))
    wide = rules.select("antecedent", F.explode("antecedent").alias("t"))
    covered = wide.join(part, "t").filter((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0)).select("antecedent").distinct()
    rules = rules.join(covered, "antecedent", "left_anti")
    single = sets.filter((F.size("items") == 1) & ~F.array_contains("items", BLOCK)).select(F.col("items")[0].alias("t"), "freq")
    rare = rules.select("antecedent", F.explode("antecedent").alias("t")).join(single, "t").groupBy("antecedent").agg(F.min_by("t", F.struct("freq", "t")).alias("key"))
    return rules.join(rare, "antecedent").select("antecedent", "key", "confidence")


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``tokens`` that some rule matches."""
    found = sets.select("tokens", F.explode("tokens").alias("key")).join(rules.select("key", "antecedent"), "key")
    return found.filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("tokens").distinct()


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest stated rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested last and so wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, small: int = 50_000, **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``labelled`` has ``url`` and ``bad``."""
    each = parse(pages.select("page_id", "url"))
    mined = cut(mine(parse(labelled.select("url", "bad")), **mining))
    index = F.broadcast(mined) if mined.count() <= small else mined
    hit = cut(blocked_sets(each.select("tokens").distinct(), index).withColumn("hit", F.lit(True)))
    each = each.join(F.broadcast(hit) if hit.count() <= small else hit, "tokens", "left")
    name, verdict = stated(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return each.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame, small: int = 1_000_000) -> DataFrame:
    """``url, bad``: pages whose path names a labelled document; bad if its quality is 0 or it is toxic."""
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 0, false) OR coalesce(toxic > 0, false)")).alias("bad"))
    bad = cut(bad)
    numbered = pages.select("url", F.expr("try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]{1,18})', 1), '') AS bigint)").alias("doc_id"))
    return numbered.filter("doc_id IS NOT NULL").join(F.broadcast(bad) if bad.count() <= small else bad, "doc_id").select("url", "bad")


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
