"""Dotted context paths: ``a.b`` is narrower than ``a``; ``world`` is above everything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD = "world"


def segments(c: Column) -> Column:
    return F.split(c, "[.]")


def depth(c: Column) -> Column:
    return F.size(segments(c))


def under(c: Column, root: str | Column) -> Column:
    """``c`` equals ``root`` or is narrower; everything is under ``world``."""
    if isinstance(root, str):
        if root == WORLD:
            return F.lit(True)
        return (c == root) | c.startswith(root + ".")
    return (root == WORLD) | (c == root) | c.startswith(F.concat(root, F.lit(".")))


def ancestors(c: Column) -> Column:
    """All prefixes of a path, the broadest first, the path itself last."""
    parts = segments(c)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def parent(c: Column) -> Column:
    parts = segments(c)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))


def prefixes(path: str) -> list[str]:
    parts = path.split(".")
    return [".".join(parts[: k + 1]) for k in range(len(parts))]


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two paths, null if their roots differ."""
    same = F.filter(ancestors(a), lambda p: F.array_contains(ancestors(b), p))
    return F.when(F.size(same) > 0, F.element_at(same, -1))


def comparable(a: Column, b: Column) -> Column:
    return (a == b) | a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit(".")))


def narrower(a: Column, b: Column) -> Column:
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


def broader(a: Column, b: Column) -> Column:
    return F.when(F.length(a) >= F.length(b), b).otherwise(a)


def path_meet(a: Column, b: Column) -> Column:
    """Meet of two paths as paths: what they share, ``world`` if nothing."""
    return F.coalesce(common_prefix(a, b), F.lit(WORLD))


def path_join(a: Column, b: Column) -> Column:
    """Join of two paths as paths: the broader of comparable ones, else ``world``."""
    return F.when(comparable(a, b), broader(a, b)).otherwise(F.lit(WORLD))


def poset_join(a: Column, b: Column) -> Column:
    """Join in the poset of contexts: the common prefix, null if there is none."""
    return common_prefix(a, b)


def poset_meet(a: Column, b: Column) -> Column:
    """Meet in the poset of contexts: the narrower of comparable ones, else the common prefix or ``world``."""
    return F.when(comparable(a, b), narrower(a, b)).otherwise(path_meet(a, b))


def visible_from(c: Column, ctx: str) -> Column:
    """``c`` is ``ctx`` or one of its ancestors: what holds there restricts down to ``ctx``."""
    return c.isin(*prefixes(ctx))


def restrict(c: Column, target: str) -> Column:
    """``target`` where a fact at ``c`` restricts to it, else null; restriction only narrows."""
    return F.when(F.lit(target) == c, F.lit(target)).when(F.lit(target).startswith(F.concat(c, F.lit("."))), F.lit(target)).when(c == WORLD, F.lit(target))
