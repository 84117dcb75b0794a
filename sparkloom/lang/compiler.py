"""Compiles a syntax tree to one lazy DataFrame; Catalyst optimises and runs it.

Value semantics: ``=`` and ``!=`` are null-safe, LIKE ignores case, division and
remainder by zero are null, SUM of nothing is 0, IN matches null with null.
Unknown tables, columns and functions raise.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.lang.parser import Between, Binary, Call, InList, IsNull, Literal, Name, Node, ParseError, Select, Star, Unary, parse, parse_expression, walk

AGGREGATES = {
    "COUNT": lambda x: F.count(x),
    "SUM": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "STDDEV": F.stddev_pop,
    "ARRAY_AGG": lambda x: F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"]),
}
SCALARS = {
    "UPPER": F.upper, "LOWER": F.lower, "LENGTH": F.length, "TRIM": F.trim, "ABS": F.abs, "ROUND": F.round, "FLOOR": F.floor,
    "CEIL": F.ceil, "SQRT": F.sqrt, "COALESCE": F.coalesce, "CONCAT": F.concat, "SUBSTR": F.substr, "REPLACE": F.replace,
    "YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOUR": F.hour, "GREATEST": F.greatest, "LEAST": F.least, "NULLIF": F.nullif,
    "SHA256": lambda x: F.sha2(x, 256), "CRC32": F.crc32, "JSON_PATH": lambda x, p: F.get_json_object(x, p),
}


def is_aggregate(node: Node) -> bool:
    """Whether an aggregate function stands anywhere in the expression."""
    return any(isinstance(n, Call) and n.name in AGGREGATES for n in walk(node))


def _like(value: Column, pattern: Column, node: Node) -> Column:
    return value.ilike(node.value) if isinstance(node, Literal) and isinstance(node.value, str) else F.ilike(value, pattern)


def column(node: Node, names: Mapping[str, Column] | None = None) -> Column:
    """The Column of an expression; ``names`` are aliases that win over input columns."""
    names = names or {}
    of = lambda n: column(n, names)
    match node:
        case Literal(value):
            return F.lit(value)
        case Name(path):
            return names[path] if path in names else F.col(path)
        case Unary("NOT", arg):
            return ~of(arg)
        case Unary("-", arg):
            return -of(arg)
        case IsNull(arg, negated):
            return of(arg).isNotNull() if negated else of(arg).isNull()
        case InList(arg, items, negated):
            hit = reduce(lambda a, b: a | b, (of(arg).eqNullSafe(of(i)) for i in items))
            return ~hit if negated else hit
        case Between(arg, low, high, negated):
            hit = of(arg).between(of(low), of(high))
            return ~hit if negated else hit
        case Binary(op, left, right):
            a, b = of(left), of(right)
            match op:
                case "=":
                    return a.eqNullSafe(b)
                case "!=":
                    return ~a.eqNullSafe(b)
                case "LIKE" | "ILIKE":
                    return _like(a, b, right)
                case "AND":
                    return a & b
                case "OR":
                    return a | b
                case "/":
                    return F.try_divide(a.cast("double"), b.cast("double"))
                case "%":
                    return F.try_mod(a, b)
            return {"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        case Call(name, args, distinct):
            if name in AGGREGATES:
                if name == "COUNT" and args == (Star(),):
                    return F.count(F.lit(1))
                if len(args) != 1 or isinstance(args[0], Star):
                    raise ParseError(f"{name} takes one argument")
                if distinct:
                    by = {"COUNT": F.count_distinct, "SUM": F.sum_distinct, "AVG": lambda x: F.expr("1") * F.try_divide(F.sum_distinct(x), F.count_distinct(x)), "ARRAY_AGG": F.collect_set}
                    return by.get(name, AGGREGATES[name])(of(args[0]))
                return AGGREGATES[name](of(args[0]))
            if name not in SCALARS:
                raise ParseError(f"unknown function {name}")
            return SCALARS[name](*[a.value if isinstance(a, Literal) and name in ("ROUND", "JSON_PATH") and i else of(a) for i, a in enumerate(args)])
        case _:
            raise ParseError("* stands alone or in COUNT(*)")


def expression(text: str) -> Column:
    """A predicate or value in the query language as a Column: operators and known functions only, nothing is evaluated."""
    node = parse_expression(text)
    if is_aggregate(node) or any(isinstance(n, Star) for n in walk(node)):
        raise ParseError("an expression has no aggregates")
    return column(node)


def label(node: Node) -> str:
    """The default name of a select item."""
    if isinstance(node, Name):
        return node.path.rsplit(".", 1)[-1]
    return f"{node.name.lower()}_result" if isinstance(node, Call) else "col"


def compile_query(q: Select, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One DataFrame for the whole query."""
    if q.table not in tables:
        raise KeyError(f"unknown table {q.table}")
    df = tables[q.table]
    if q.where is not None:
        df = df.filter(column(q.where))
    grouped = bool(q.group_by) or q.having is not None or any(is_aggregate(i.expr) for i in q.items)
    if any(isinstance(i.expr, Star) for i in q.items):
        if grouped or len(q.items) > 1:
            raise ParseError("* cannot be combined with grouping or other items")
        out, named = df, {}
    else:
        used: dict[str, int] = {}
        pairs = []
        for i in q.items:
            name = i.alias or label(i.expr)
            used[name] = used.get(name, 0) + 1
            pairs.append((name if used[name] == 1 else f"{name}_{used[name]}", i.expr))
        if len({n for n, _ in pairs}) < len(pairs):
            raise ParseError("select items need distinct names")
        named = dict(pairs)
    if grouped:
        keys = {f"__k{i}": e for i, e in enumerate(q.group_by)}
        by = {e: k for k, e in keys.items()}
        aggregates = {n: (column(e) if is_aggregate(e) else F.first(column(e))).alias(n) for n, e in named.items() if e not in by}
        extra: dict[str, Node] = {}

        def lift(e: Node) -> Node:
            """Names the aggregates of HAVING and ORDER BY that are no select items."""
            if e in by:
                return Name(by[e])
            for n, x in named.items():
                if e == x or e == Name(n):
                    return Name(n)
            if isinstance(e, Call) and e.name in AGGREGATES:
                n = next((k for k, x in extra.items() if x == e), f"__x{len(extra)}")
                extra[n] = e
                return Name(n)
            if isinstance(e, Binary):
                return Binary(e.op, lift(e.left), lift(e.right))
            if isinstance(e, Unary):
                return Unary(e.op, lift(e.arg))
            if isinstance(e, (InList, Between, IsNull)):
                return type(e)(lift(e.arg), *[getattr(e, f) for f in e.__dataclass_fields__ if f != "arg"])
            return e

        having = lift(q.having) if q.having is not None else None
        order = [(lift(o.expr), o) for o in q.order_by]
        agg = [*aggregates.values(), *[column(e).alias(n) for n, e in extra.items()]] or [F.count(F.lit(1)).alias("__n")]
        df = df.groupBy(*[column(e).alias(k) for k, e in keys.items()]).agg(*agg)
        for n, e in named.items():
            if e in by:
                df = df.withColumn(n, F.col(by[e]))
        if having is not None:
            df = df.filter(column(having))
        chosen = list(named)
    else:
        order = [(o.expr, o) for o in q.order_by]
        if named:
            aliases = {n: column(e) for n, e in named.items() if n not in df.columns}
            out = df.select(*[column(e).alias(n) for n, e in named.items()])
            if q.distinct:
                df, aliases = out, {}
            elif order:
                at = [(column(e, aliases).alias(f"__o{i}")) for i, (e, _) in enumerate(order)]
                df = df.select(*[column(e).alias(n) for n, e in named.items()], *at)
                order = [(Name(f"__o{i}"), o) for i, (_, o) in enumerate(order)]
            else:
                df = out
        chosen = list(named) or df.columns
    if q.distinct:
        df = df.select(*[F.col(f"`{c}`") for c in chosen]).distinct()
    if order:
        keys = []
        for e, o in order:
            c, first = column(e), (not o.descending) if o.nulls_first is None else o.nulls_first
            keys.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if o.descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        df = df.orderBy(*keys)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def run_query(text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Parses and compiles a query text."""
    return compile_query(parse(text), tables)
