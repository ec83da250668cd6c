"""Conditions over variables that have a textual and a numeric reading.

A name next to a number or inside arithmetic is read as a number, otherwise as
text; the choice is made when the plan is built, so the comparison itself is an
ordinary typed Column.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column

from factloom.functions.expressions import ExpressionError, _Compiler

Reading = Callable[[str], tuple[Column, Column]]
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")


class _Typed(_Compiler):
    def __init__(self, read: Reading, numeric: bool = False):
        self.read = read
        super().__init__(lambda name: read(name)[1 if numeric else 0])

    def _numeric(self, node: ast.AST) -> bool:
        if isinstance(node, ast.Constant):
            return isinstance(node.value, (int, float)) and not isinstance(node.value, bool)
        return isinstance(node, ast.BinOp) or isinstance(node, ast.UnaryOp) and not isinstance(node.op, ast.Not) and self._numeric(node.operand)

    def on_compare(self, node: ast.Compare) -> Column:
        sides = [node.left, *node.comparators]
        sides += [x for s in sides if isinstance(s, (ast.List, ast.Tuple)) for x in s.elts]
        return _Compiler.on_compare(_Typed(self.read, True) if any(map(self._numeric, sides)) else self, node)

    def on_binop(self, node: ast.BinOp) -> Column:
        return _Compiler.on_binop(_Typed(self.read, True), node)


def condition(text: str, read: Reading) -> Column:
    """A condition with ``?names``, ``= != < <= > >=``, ``&& || !`` or ``AND OR NOT``, ``IN (..)``, ``IS [NOT] NULL``."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f" __text{len(kept) - 1}__ "

    s = _LITERAL.sub(keep, text)
    s = re.sub(r"\?", " ", s)
    s = s.replace("&&", " and ").replace("||", " or ").replace("<>", "!=")
    s = re.sub(r"!(?!=)", " not ", s)
    s = re.sub(r"(?<![<>!=])=(?!=)", "==", s)
    s = re.sub(r"(?i)\bis\s+not\s+null\b", " is not None ", s)
    s = re.sub(r"(?i)\bis\s+null\b", " is None ", s)
    s = re.sub(r"(?i)\b(and|or|not|in)\b", lambda m: m[0].lower(), s)
    s = re.sub(r"(?i)\b(true|false|null)\b", lambda m: {"true": "True", "false": "False", "null": "None"}[m[0].lower()], s)
    s = re.sub(r"\bin\s*\(([^()]*)\)", r" in [\1]", s)
    s = re.sub(r"__text(\d+)__", lambda m: kept[int(m[1])], s)
    try:
        tree = ast.parse(s.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot read the condition {text!r}") from e
    return _Typed(read).visit(tree)
