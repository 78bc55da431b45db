"""Rule templates with arithmetic on one number, compiled to columns; nothing is ever evaluated as Python."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOLE = re.compile(r"\{([^{}:]+)(?::0?(\d*)d)?\}")


def arithmetic(text: str, x: Column) -> Column:
    """+ - * / // % and parentheses over integers and a single name."""

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) is int:
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return x
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.FloorDiv | ast.Div):
                return F.floor(a / F.nullif(b, F.lit(0)))
            if isinstance(node.op, ast.Mod):
                return F.pmod(a, F.nullif(b, F.lit(0)))
        raise ValueError(f"not allowed in a rule: {ast.dump(node)}")

    return build(ast.parse(text.strip(), mode="eval").body)


def template(rule: str, x: Column) -> Column:
    """Text with {x}, {x:02d} or {expression}; numbers shorter than the width are padded with zeros."""
    parts, at = [], 0
    for m in _HOLE.finditer(rule):
        value = arithmetic(m[1], x).cast("bigint").cast("string")
        if m[2]:
            value = F.when(F.length(value) >= int(m[2]), value).otherwise(F.lpad(value, int(m[2]), "0"))
        parts += [F.lit(rule[at : m.start()]), value]
        at = m.end()
    return F.concat(*parts, F.lit(rule[at:]))


def wire_pair(x: Column, rule: str = "BK{x:02d}, WT{x:02d}") -> Column:
    """The first two comma parts of a wire rule as an array."""
    return F.slice(F.transform(F.split(template(rule, x), ","), lambda p: F.trim(p)), 1, 2)


def terminals(x: Column, rule: str | None = None, scr: str = "SCR") -> Column:
    """Terminal texts of a tag number; by default n and n + 1. Parts that name a screen, and blank parts, are dropped."""
    if rule is None:
        return F.array(x.cast("string"), (x + 1).cast("string"))
    parts = F.transform(F.split(template(rule, x), ","), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: (p != "") & ~F.upper(p).contains(scr.upper())), 1, 2)


def identifier_regex(prefixes: list[str], optional_digit: bool = True) -> str:
    """A pattern for identifiers that begin with one of the given prefixes; without prefixes nothing matches."""
    if not prefixes:
        return "(?!)"
    alternatives = "|".join(re.escape(p.upper()) for p in sorted(prefixes, key=len, reverse=True))
    return rf"(?i)(?<![A-Z0-9])((?:{alternatives})(?![A-Z])[-_ ]?[A-Z0-9._-]*{'' if optional_digit else '[0-9]'}[A-Z0-9]*)"
