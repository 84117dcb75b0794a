import pytest

from sparkloom.lang import ParseError, parse, run_query
from sparkloom.lang.parser import Binary, Name, Unary, tokenize, walk


def run(spark, text, rows, schema="k int, v int, s string"):
    return [tuple(r) for r in run_query(text, {"t": spark.createDataFrame(rows, schema)}).collect()]


ROWS = [(1, 10, "ABC"), (1, 20, "abd"), (2, 30, "xyz"), (None, None, None)]


def test_lexer():
    kinds = [(t.kind, t.value) for t in tokenize("SELECT a.b, 'x\\'y' -- c\n<> /* d */ 1.5e2")]
    assert kinds == [("keyword", "SELECT"), ("name", "a.b"), ("op", ","), ("string", "x'y"), ("op", "!="), ("number", 150.0), ("end", None)]
    with pytest.raises(ParseError, match="line 2, column 3"):
        tokenize("a\nb #")


def test_precedence():
    q = parse("SELECT a FROM t WHERE NOT a = 1 OR b + 2 * c > 3 AND d")
    assert isinstance(q.where, Binary) and q.where.op == "OR" and isinstance(q.where.left, Unary)
    assert q.where.right.op == "AND" and q.where.right.left.left.op == "+"
    assert sum(isinstance(n, Name) for n in walk(q)) == 5


@pytest.mark.parametrize("text", ["SELECT a FROM t UNION SELECT b FROM u", "SELECT FROM t", "SELECT a FROM t LIMIT 1.5", "SELECT a FROM t WHERE a NOT 1", "SELECT a b c FROM t"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_null_safe_and_like(spark):
    assert len(run(spark, "SELECT v FROM t WHERE v != 10", ROWS)) == 3
    assert run(spark, "SELECT v FROM t WHERE s LIKE 'a%' ORDER BY v", ROWS) == [(10,), (20,)]
    assert run(spark, "SELECT v / 0 AS d, v % 0 AS m FROM t WHERE v = 10", ROWS) == [(None, None)]
    assert run(spark, "SELECT k FROM t WHERE v IN (NULL, 30) ORDER BY k NULLS LAST", ROWS) == [(2,), (None,)]
    assert run(spark, "SELECT k FROM t WHERE s IS NULL", ROWS) == [(None,)]


def test_grouping(spark):
    assert run(spark, "SELECT k, SUM(v) AS s, COUNT(*) AS n FROM t GROUP BY k HAVING COUNT(*) > 1 ORDER BY SUM(v) DESC", ROWS) == [(1, 30, 2)]
    assert run(spark, "SELECT COUNT(*), SUM(v) FROM t WHERE v > 99", ROWS) == [(0, 0)]
    assert run(spark, "SELECT k FROM t GROUP BY k ORDER BY k NULLS FIRST", ROWS) == [(None,), (1,), (2,)]


def test_order_by_input_column(spark):
    assert run(spark, "SELECT s FROM t ORDER BY v DESC NULLS LAST LIMIT 1 OFFSET 1", ROWS) == [("abd",)]


def test_unknown(spark):
    with pytest.raises(ParseError, match="unknown function"):
        run(spark, "SELECT NOPE(v) FROM t", ROWS)
    with pytest.raises(KeyError):
        run(spark, "SELECT v FROM u", ROWS)
    with pytest.raises(ParseError):
        run(spark, "SELECT * FROM t GROUP BY k", ROWS)


def test_expressions_alone(spark):
    from sparkloom.lang import ParseError, expression

    d = spark.createDataFrame([(1, "Ab"), (None, "x")], "a int, b string")
    assert [r[0] for r in d.select(expression("a != 1 OR UPPER(b) = 'AB'")).collect()] == [True, True]
    for bad in ("a + ", "SUM(a)", "a = 1; b", "system('x')", "*"):
        with pytest.raises(ParseError):
            expression(bad)
