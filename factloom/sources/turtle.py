"""Turtle: prefixes, ``a``, ``;`` and ``,`` lists, IRIs, names, literals, blank nodes, property lists ``[ ]`` and collections ``( )``.

``parse`` reads a run of whole statements.  What is open stands on a stack, so
nesting may be as deep as it likes.  Nodes without a label get names from
``node``, which has to differ from run to run of one file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<iri><[^<>"\s]*>)|(?P<at>@\w+(?:-\w+)*)|(?P<type>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>(?:[\w-]+(?:\.[\w-]+)*)?:(?:[\w%-]+(?:\.[\w%-]+)*)?)|(?P<word>\w+)|(?P<op>[.;,\[\]()])""",
    re.S,
)
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TYPE, _FIRST, _REST, _NIL = _RDF + "type", _RDF + "first", _RDF + "rest", _RDF + "nil"

class TurtleError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def _plain(text: str) -> str:
    table = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else table.get(m[1], m[1]), text, flags=re.S)


@dataclass
class _Open:
    """A statement, a property list or a collection that is being read."""

    kind: str  # ".", "]" or ")": what ends it
    wants: str = "subject"  # then "predicate", "object", "more"
    subject: str = ""
    predicate: str = ""
    bare: bool = False  # a property list is its subject: predicates may be missing
    head: str = _NIL
    last: str = ""


def parse(text: str, prefixes: Mapping[str, str] | None = None, base: str = "", node: str = "n") -> Iterator[tuple[str, str, str, bool]]:
    """(subject, predicate, object, object is a reference)."""
    tokens, at, known, made = _tokens(text), 0, dict(prefixes or {}), 0
    stack: list[_Open] = []
    out: list[tuple[str, str, str, bool]] = []

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ("end", "the end")

    def look() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "the end")

    def new() -> str:
        nonlocal made
        made += 1
        return f"_:{node}-{made}"

    def iri(kind: str, word: str) -> str:
        if kind == "iri":
            return word[1:-1] if ":" in word else base + word[1:-1]
        if kind == "name":
            prefix, _, local = word.partition(":")
            if prefix == "_":
                return word
            if prefix not in known:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return known[prefix] + local
        raise TurtleError(f"expected a name, got {word}")

    def value(kind: str, word: str) -> tuple[str, bool]:
        if kind in ("str", "long"):
            cut = 3 if kind == "long" else 1
            if look()[0] == "at":
                take()
            elif look()[0] == "type":
                take()
                iri(*take())
            return _plain(word[cut:-cut]), False
        if kind == "num" or word in ("true", "false"):
            return word, False
        return iri(kind, word), True

    def put(what: str, is_ref: bool, bare: bool = False) -> None:
        top = stack[-1]
        if top.kind == ")":
            cell = new()
            if top.last:
                out.append((top.last, _REST, cell, True))
            else:
                top.head = cell
            out.append((cell, _FIRST, what, is_ref))
            top.last = cell
        elif top.wants == "subject" and is_ref:
            top.subject, top.wants, top.bare = what, "predicate", bare
        elif top.wants == "object":
            out.append((top.subject, top.predicate, what, is_ref))
            top.wants = "more"
        else:
            raise TurtleError(f"{what!r} cannot stand here")

    def close(word: str) -> None:
        top = stack.pop() if stack else None
        if top is None or top.kind != word:
            raise TurtleError(f"nothing ends with {word!r} here")
        if top.kind == ")":
            if top.last:
                out.append((top.last, _REST, _NIL, True))
            put(top.head, True)
        elif not (top.wants == "more" or top.wants == "predicate" and (top.bare or top.predicate)):
            raise TurtleError(f"{word!r} comes too early")
        elif top.kind == "]":
            put(top.subject, True, bare=True)

    while at < len(tokens):
        kind, word = take()
        if not stack:
            if kind in ("at", "word") and word.lower().lstrip("@") in ("prefix", "base"):
                if word.lower().endswith("prefix"):
                    name = take()[1]
                    known[name.rstrip(":")] = iri(*take())
                else:
                    base = iri(*take())
                if word[0] == "@" and take()[1] != ".":
                    raise TurtleError("a declaration does not end with '.'")
                continue
            stack.append(_Open("."))
        top = stack[-1]
        if kind == "op" and word in ".])":
            close(word)
            if not stack:
                yield from out
                out.clear()
        elif kind == "op" and word in ",;":
            if top.kind == ")" or not (top.wants == "more" or word == ";" and top.wants == "predicate" and top.predicate):
                raise TurtleError(f"{word!r} cannot stand here")
            top.wants = "object" if word == "," else "predicate"
        elif top.wants == "predicate" and top.kind != ")":
            top.predicate, top.wants = _TYPE if (kind, word) == ("word", "a") else iri(kind, word), "object"
        elif word == "[" and kind == "op":
            stack.append(_Open("]", "predicate", new(), bare=True))
        elif word == "(" and kind == "op":
            stack.append(_Open(")", ""))
        else:
            put(*value(kind, word))
    if stack:
        raise TurtleError("the text ends within a statement")
