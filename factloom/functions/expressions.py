"""A safe expression language compiled to one Column.

Accepted are numbers, strings, booleans, None, names, ``+ - * / // % **``,
unary signs and ``not``, ``and``/``or``, chained comparisons, ``in`` and
``is``.  ``//`` and ``%`` follow the sign of the divisor.  Anything else is
refused when the expression is compiled, and unknown names fail in analysis;
nothing is ever evaluated on the driver.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


def compile_expression(text: str, names: Mapping[str, Column] | Callable[[str], Column] = F.col) -> Column:
    """``text`` as a Column; ``names`` maps or resolves identifiers, dotted ones too."""
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot read {text!r}: {e.msg}") from e
    if callable(names):
        resolve = names
    else:

        def resolve(name: str) -> Column:
            if name not in names:
                raise ExpressionError(f"unknown name {name!r}")
            return names[name]

    return _Compiler(resolve).visit(tree)


class _Compiler:
    def __init__(self, resolve: Callable[[str], Column]):
        self.resolve = resolve

    def visit(self, node: ast.AST) -> Column:
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler is None:
            raise ExpressionError(f"{type(node).__name__} is not allowed")
        return handler(node)

    def on_constant(self, node: ast.Constant) -> Column:
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            raise ExpressionError(f"constant {node.value!r} is not allowed")
        return F.lit(node.value)

    def on_name(self, node: ast.Name) -> Column:
        return self.resolve(node.id)

    def on_attribute(self, node: ast.Attribute) -> Column:
        parts, at = [node.attr], node.value
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        if not isinstance(at, ast.Name):
            raise ExpressionError("only names have fields")
        return self.resolve(".".join([at.id, *reversed(parts)]))

    def on_unaryop(self, node: ast.UnaryOp) -> Column:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return ~x.cast("boolean")
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        raise ExpressionError("operator is not allowed")

    def on_binop(self, node: ast.BinOp) -> Column:
        a, b = self.visit(node.left), self.visit(node.right)
        kind = type(node.op)
        if kind is ast.Add:
            return a + b
        if kind is ast.Sub:
            return a - b
        if kind is ast.Mult:
            return a * b
        if kind is ast.Div:
            return F.try_divide(a, b)
        if kind is ast.FloorDiv:
            return F.floor(F.try_divide(a, b))
        if kind is ast.Mod:
            return a - b * F.floor(F.try_divide(a, b))
        if kind is ast.Pow:
            return F.pow(a, b)
        raise ExpressionError("operator is not allowed")

    def on_boolop(self, node: ast.BoolOp) -> Column:
        parts = [self.visit(v).cast("boolean") for v in node.values]
        return reduce(lambda x, y: x & y if isinstance(node.op, ast.And) else x | y, parts)

    def on_compare(self, node: ast.Compare) -> Column:
        left, out = node.left, None
        for op, right in zip(node.ops, node.comparators):
            step = self._compared(op, left, right)
            out = step if out is None else out & step
            left = right
        return out

    def _compared(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        a = self.visit(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                raise ExpressionError("'in' takes a literal list")
            found = a.isin(*(self.visit(x) for x in right.elts)) if right.elts else F.lit(False)
            return ~found if isinstance(op, ast.NotIn) else found
        b = self.visit(right)
        table = {
            ast.Eq: lambda: a == b,
            ast.NotEq: lambda: a != b,
            ast.Lt: lambda: a < b,
            ast.LtE: lambda: a <= b,
            ast.Gt: lambda: a > b,
            ast.GtE: lambda: a >= b,
            ast.Is: lambda: a.eqNullSafe(b),
            ast.IsNot: lambda: ~a.eqNullSafe(b),
        }
        if type(op) not in table:
            raise ExpressionError("comparison is not allowed")
        return table[type(op)]()
