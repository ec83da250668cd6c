"""Licence scans over a positional rare-token index, in DataFrame operations only.

Every whole text is cut into words once; of the words that occur in licence
phrases or templates it keeps the postings, one number for position and word
each.  Document frequencies of those few words over all documents give their
IDF.  A template or phrase is then looked up from its rarest word: that word's
postings propose relative starts, the postings of the other words, shifted by
their offsets, are intersected with them, and the template's mandatory phrase
has to stand there word by word.  Intersections go by hash and coverages by one
sorted pass, so a text of many licences takes no more than its words.  All of
it stays within a row, so nothing is shuffled but the word counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.work import Workspace

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices by label, with the phrase that has to stand in them.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
]
#: Words of templates that are too common everywhere to say anything; only mandatory phrases, which stand whole, have them.
COMMON = frozenset("the of to and in is or a are any this with use".split())
#: IDF share of a template's words that has to be found at one alignment.
COVERAGE = 0.7
#: A posting is ``position * SLOT + word``.
SLOT = 1 << 16


def _entries(text: str) -> list[tuple[int, str]]:
    return [(k, w) for k, w in enumerate(text.split()) if w not in COMMON]


def vocabulary(base: Mapping[str, str] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[str]:
    """The words that are looked up: all of base and mandatory phrases, all but the common ones of templates."""
    phrases = [*base, *(m for _, _, m in templates)]
    words = sorted({w for p in phrases for w in p.split()} | {w for _, t, _ in templates for _, w in _entries(t)})
    if len(words) > SLOT:
        raise ValueError(f"{len(words)} licence words; the postings hold {SLOT}")
    return words


def postings(docs: DataFrame, vocab: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and the postings of every row."""
    known = F.create_map(*(x for k, w in enumerate(vocab) for x in (F.lit(w), F.lit(k))))
    ascii_lower = lambda w: F.translate(w, UPPER, LOWER)
    words = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    # The cheap test comes first; lower() also folds letters beyond A-Z, so its hits are looked at again.
    near = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(*vocab), F.struct(i.cast("long").alias("at"), w.alias("w")))), lambda x: x.isNotNull()).alias("near"))
    found = F.filter(F.transform("near", lambda x: x["at"] * SLOT + F.try_element_at(known, ascii_lower(x["w"]))), lambda x: x.isNotNull())
    return near.select("doc_id", "n_words", found.alias("post"))


def _starts(post: Column, words: Sequence[tuple[int, int]], idf: Sequence[float]) -> Column:
    """Starts at which all (offset, word) of ``words`` stand, proposed by the rarest word."""
    off, rare = max(words, key=lambda x: (idf[x[1]], -x[0]))
    starts = F.filter(_shifted(post, off, rare), lambda s: s >= 0)
    held = starts
    for k, w in words:
        if (k, w) != (off, rare):
            held = F.array_intersect(held, _shifted(post, k, w))
    return F.when(F.size(starts) > 0, held).otherwise(F.array().cast("array<bigint>"))


def _shifted(post: Column, off: int, word: int) -> Column:
    """Where something would start in which ``word`` stands at ``off``."""
    return F.transform(F.filter(post, lambda x: x % SLOT == word), lambda x: F.floor(x / SLOT).cast("long") - off)


def _alignments(post: Column, must: Sequence[tuple[int, int]], idf: Sequence[float]) -> Column:
    """Where a template would start if its mandatory phrase stands where it stands; ``must`` has its offsets within the template."""
    first = min(k for k, _ in must)
    return F.transform(_starts(post, [(k - first, w) for k, w in must], idf), lambda s: s - first)


def _coverage(post: Column, starts: Column, entries: Sequence[tuple[int, int]], idf: Sequence[float]) -> Column:
    """IDF share of the template's words at the best of its alignments; 0 without one."""
    total = sum(idf[w] for _, w in entries)

    def share(k: int, w: int) -> Column:
        part = [F.lit(k).alias("k"), F.lit(idf[w] / total).alias("share")]
        return F.transform(F.array_intersect(starts, _shifted(post, k, w)), lambda s: F.struct(s.alias("s"), *part))

    # Shares by start, one after the other: the sum of the start at hand, and the best sum so far.
    none = F.struct(F.lit(None).cast("long").alias("s"), F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))

    def add(at: Column, x: Column) -> Column:
        now = F.when(at["s"].eqNullSafe(x["s"]), at["now"]).otherwise(F.lit(0.0)) + x["share"]
        return F.struct(x["s"].alias("s"), now.alias("now"), F.greatest(at["best"], now).alias("best"))

    best = F.aggregate(F.array_sort(F.flatten(F.array(*(share(k, w) for k, w in entries)))), none, add, lambda at: at["best"])
    return F.when(F.size(starts) > 0, best).otherwise(F.lit(0.0))


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A template gives its label where its mandatory phrase stands and at least
    ``COVERAGE`` of its IDF is found at that alignment; ``score`` is 1 with a
    base label and else the best coverage.  Defined results: a null or empty
    text has no words, no labels and score 0; repeated rows are each reported;
    an empty input gives an empty result.  Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "licences")
    vocab = vocabulary(base, templates)
    number = {w: k for k, w in enumerate(vocab)}
    found = ws.table(postings(docs, vocab, id_col, text_col), "postings")
    # At most one row per licence word comes back, whatever the input.
    df = dict(found.select(F.explode(F.array_distinct(F.transform("post", lambda x: x % SLOT))).alias("w")).groupBy("w").count().collect())
    n = found.count()
    idf = [math.log((n + 1) / (df.get(k, 0) + 1)) + 1e-9 for k in range(len(vocab))]
    post = F.col("post")
    phrases = {p: _starts(post, [(k, number[w]) for k, w in enumerate(p.split())], idf) for p in base}
    needs = []
    for _, text, must in templates:
        at = _offset(text.split(), must.split())
        needs.append([(o + at, number[w]) for o, w in enumerate(must.split())])
    # Starts are columns of their own, so that they are computed once and not for each word of a template.
    out = found.select("doc_id", "n_words", "post", *(s.alias(f"base_{k}") for k, s in enumerate(phrases.values())), *(_alignments(post, need, idf).alias(f"at_{k}") for k, need in enumerate(needs)))
    covers = [_coverage(post, F.col(f"at_{k}"), [(o, number[w]) for o, w in _entries(text)], idf) for k, (_, text, _) in enumerate(templates)]
    out = out.select("doc_id", "n_words", *(f"base_{k}" for k in range(len(base))), *(c.alias(f"cover_{k}") for k, c in enumerate(covers)))
    every = F.flatten(F.array(*(F.col(f"base_{k}") for k in range(len(base)))))
    has = [F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, label in enumerate(base.values())]
    more = [F.when(F.col(f"cover_{k}") >= COVERAGE, F.lit(label)) for k, (label, _, _) in enumerate(templates)]
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",")
    best = F.greatest(*(F.col(f"cover_{k}") for k in range(len(templates))), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        joined(has).alias("base_labels"),
        joined(has + more).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.round(F.least(best, F.lit(1.0)), 6)).alias("score"),
    )


def _offset(text: list[str], part: list[str]) -> int:
    for k in range(len(text) - len(part) + 1):
        if text[k : k + len(part)] == part:
            return k
    raise ValueError(f"{' '.join(part)!r} does not stand in {' '.join(text)!r}")
