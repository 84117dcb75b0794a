"""The query language: text -> syntax tree -> one lazy DataFrame."""

from sparkloom.lang.compiler import expression, run_query
from sparkloom.lang.parser import ParseError, parse

__all__ = ["ParseError", "expression", "parse", "run_query"]
