"""Lexer, syntax tree and recursive-descent parser of the query language.

``SELECT [DISTINCT] items FROM name [WHERE e] [GROUP BY e, ...] [HAVING e]
[ORDER BY e [ASC|DESC] [NULLS FIRST|LAST], ...] [LIMIT n [OFFSET m]]``

Precedence, loosest first: OR, AND, NOT, comparison (also [NOT] IN, BETWEEN,
LIKE, ILIKE, IS [NOT] NULL), + and -, * / %, unary minus. Anything left after a
complete query is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

KEYWORDS = frozenset("SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER ASC DESC NULLS FIRST LAST LIMIT OFFSET AS AND OR NOT IN BETWEEN LIKE ILIKE IS NULL TRUE FALSE".split())
TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)"
    r"|(?P<word>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$0-9][\w$]*)*)|(?P<op><>|!=|<=|>=|[-+*/%=<>(),])",
    re.DOTALL,
)


class ParseError(ValueError):
    """A query text that the grammar does not accept, with line and column."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    line: int
    column: int


def tokenize(text: str) -> list[Token]:
    """All tokens of a query text, then an end token."""
    out, at = [], 0
    where = lambda i: (text.count("\n", 0, i) + 1, i - text.rfind("\n", 0, i))
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at line {where(at)[0]}, column {where(at)[1]}")
        raw, kind = m[0], m.lastgroup
        if kind == "string":
            escapes = {"n": "\n", "t": "\t", "r": "\r"}
            out.append(Token("string", re.sub(r"\\(.)", lambda e: escapes.get(e[1], e[1]), raw[1:-1], flags=re.DOTALL), *where(at)))
        elif kind == "number":
            out.append(Token("number", float(raw) if re.search("[.eE]", raw) else int(raw), *where(at)))
        elif kind == "word":
            key = raw.upper()
            out.append(Token("keyword", key, *where(at)) if key in KEYWORDS else Token("name", raw, *where(at)))
        elif kind == "op":
            out.append(Token("op", "!=" if raw == "<>" else raw, *where(at)))
        at = m.end()
    return [*out, Token("end", None, *where(len(text)))]


@dataclass(frozen=True)
class Node:
    """Base of all syntax nodes."""


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Name(Node):
    path: str


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool = False


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    table: str
    where: Node | None = None
    group_by: tuple[Node, ...] = ()
    having: Node | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = field(default=False)


def walk(node: Node):
    """The node and all below it, parents first."""
    yield node
    for f in fields(node):
        value = getattr(node, f.name)
        for child in value if isinstance(value, tuple) else (value,):
            if isinstance(child, Node):
                yield from walk(child)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        t = self.now
        raise ParseError(f"{wanted} expected at line {t.line}, column {t.column}, not {t.value if t.kind != 'end' else 'the end'!r}")

    def accept(self, kind: str, *values) -> Token | None:
        t = self.now
        if t.kind == kind and (not values or t.value in values):
            self.at += 1
            return t
        return None

    def expect(self, kind: str, *values) -> Token:
        return self.accept(kind, *values) or self.fail(" or ".join(map(str, values)) or kind)

    def many(self, one):
        out = [one()]
        while self.accept("op", ","):
            out.append(one())
        return tuple(out)

    def select(self) -> Select:
        self.expect("keyword", "SELECT")
        distinct = bool(self.accept("keyword", "DISTINCT"))
        items = self.many(self.item)
        self.expect("keyword", "FROM")
        table = self.expect("name").value
        where = self.expr() if self.accept("keyword", "WHERE") else None
        group, having, order, limit, offset = (), None, (), None, 0
        if self.accept("keyword", "GROUP"):
            self.expect("keyword", "BY")
            group = self.many(self.expr)
        if self.accept("keyword", "HAVING"):
            having = self.expr()
        if self.accept("keyword", "ORDER"):
            self.expect("keyword", "BY")
            order = self.many(self.order)
        if self.accept("keyword", "LIMIT"):
            limit = self.whole()
            if self.accept("keyword", "OFFSET"):
                offset = self.whole()
        if self.now.kind != "end":
            self.fail("end of the query")
        return Select(items, table, where, group, having, order, limit, offset, distinct)

    def whole(self) -> int:
        t = self.expect("number")
        if not isinstance(t.value, int):
            raise ParseError(f"a whole number is needed at line {t.line}, column {t.column}")
        return t.value

    def item(self) -> Item:
        if self.accept("op", "*"):
            return Item(Star())
        e = self.expr()
        if self.accept("keyword", "AS"):
            return Item(e, self.expect("name").value)
        alias = self.accept("name")
        return Item(e, alias.value if alias else None)

    def order(self) -> Order:
        e = self.expr()
        down = bool(self.accept("keyword", "DESC")) or (self.accept("keyword", "ASC") and False)
        first = None
        if self.accept("keyword", "NULLS"):
            first = self.expect("keyword", "FIRST", "LAST").value == "FIRST"
        return Order(e, bool(down), first)

    def left(self, one, *ops):
        out = one()
        while t := self.accept(*ops):
            out = Binary(t.value, out, one())
        return out

    def expr(self) -> Node:
        return self.left(self.conjunction, "keyword", "OR")

    def conjunction(self) -> Node:
        return self.left(self.negation, "keyword", "AND")

    def negation(self) -> Node:
        return Unary("NOT", self.negation()) if self.accept("keyword", "NOT") else self.comparison()

    def comparison(self) -> Node:
        out = self.sum()
        while True:
            if t := self.accept("op", "=", "!=", "<", "<=", ">", ">="):
                out = Binary(t.value, out, self.sum())
            elif self.accept("keyword", "IS"):
                negated = bool(self.accept("keyword", "NOT"))
                self.expect("keyword", "NULL")
                out = IsNull(out, negated)
            else:
                start = self.at
                negated = bool(self.accept("keyword", "NOT"))
                if self.accept("keyword", "IN"):
                    self.expect("op", "(")
                    items = self.many(self.expr)
                    self.expect("op", ")")
                    out = InList(out, items, negated)
                elif self.accept("keyword", "BETWEEN"):
                    low = self.sum()
                    self.expect("keyword", "AND")
                    out = Between(out, low, self.sum(), negated)
                elif t := self.accept("keyword", "LIKE", "ILIKE"):
                    like = Binary(t.value, out, self.sum())
                    out = Unary("NOT", like) if negated else like
                else:
                    self.at = start
                    return out

    def sum(self) -> Node:
        return self.left(self.product, "op", "+", "-")

    def product(self) -> Node:
        return self.left(self.unary, "op", "*", "/", "%")

    def unary(self) -> Node:
        return Unary("-", self.unary()) if self.accept("op", "-") else self.primary()

    def primary(self) -> Node:
        if t := self.accept("number") or self.accept("string"):
            return Literal(t.value)
        if t := self.accept("keyword", "TRUE", "FALSE", "NULL"):
            return Literal({"TRUE": True, "FALSE": False, "NULL": None}[t.value])
        if self.accept("op", "("):
            e = self.expr()
            self.expect("op", ")")
            return e
        name = self.expect("name").value
        if not self.accept("op", "("):
            return Name(name)
        distinct = bool(self.accept("keyword", "DISTINCT"))
        args = (Star(),) if self.accept("op", "*") else () if self.now.value == ")" else self.many(self.expr)
        self.expect("op", ")")
        return Call(name.upper(), args, distinct)


def parse_expression(text: str) -> Node:
    """The syntax tree of an expression on its own."""
    p = _Parser(text)
    out = p.expr()
    p.expect("end")
    return out


def parse(text: str) -> Select:
    """The syntax tree of a query."""
    return _Parser(text).select()
