"""Packing, the filter audit and the divergence audit against plain Python, on small and odd tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import catalog, divergence, filter_audit, packing
from tests.llm.test_operators import docs, none, odd  # noqa: F401

# packing


def check_pieces(pieces, texts):
    """``texts``: (doc_id, text) of every row, repeated ones too."""
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, text in texts:
        want[i, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4").tobytes()] += 1
    of = defaultdict(list)
    places = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length > 0
        of[r.doc_id, r.doc_tokens].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= packing.LENGTH and end & (end - 1) == 0
    have = Counter()
    for (i, n), rows in of.items():
        if len({r.start for r in rows}) == len(rows):
            rows.sort(key=lambda r: r.start)
            assert [r.start for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]]
            have[i, b"".join(r.ids for r in rows)] += 1
            assert sum(r.length for r in rows) == n
        else:  # rows that repeat an id: their pieces cover each id once a row
            assert sum(r.length for r in rows) == sum(k for (j, x), k in want.items() if j == i and len(x) == 4 * n) * n
            have.update({k: v for k, v in want.items() if k[0] == i and len(k[1]) == 4 * n})
    assert have == want


def test_pack_odd_rows(odd):  # noqa: F811
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_pieces(packing.pack(odd).collect(), texts)
    check_pieces(packing.pack(odd, unit=300).collect(), texts)
    check_pieces(packing.pack(odd).coalesce(1).collect(), texts)


def test_pack_empty(none):  # noqa: F811
    assert packing.pack(none).collect() == []


ODD_TEXTS = ["it's They'LL 's ' s", "a\u0301 \u0301b e\u0301 H\u0331 h\u0331. (H\u0331)", "x\u00a0y\u2003z\x1c\x1d", "<|endoftext|> a<|startoftext|>b <|END", "ΣΑΣ ΟΔΟΣ İ ß", "한글 ㄱ가 中文字", "a\x00b\x0bc\x0cd", "x" * 300 + " y " + "é" * 90 + " z", "  \t\n ", "", "१२३ ½ 12"]
ODD_TEXTS += ["(word) word, word's. \"Word\" 'word' w-o-r-d --word-- 12,5 5. .5 a.b. é. .é é.a <b> =a= a=\u0338 €5 (é) “q” x² ?! ?a!'", "A" * 64 + " " + "a" * 65 + ".", "naïve Straße ÀÉ ñandú"]


def test_words_alone_give_the_ids_of_texts():
    tokenizer, encode = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    assert [x.tolist() for x in encode(ODD_TEXTS)] == want
    assert [x.tolist() for x in encode([*ODD_TEXTS[::-1], None])] == [*want[::-1], []]
    assert [encode([t])[0].tolist() for t in ODD_TEXTS] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abHI .,'\"-=<|>%5 \n\u0301\u0331\u0338éßİΣ中²½\u00a0\u200d"), max_size=12), max_size=4))
def test_any_text(texts):
    encode = packing.encoder(packing.vocabulary())
    assert [x.tolist() for x in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 8)
    tokenizer, encode = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    for k in range(30):
        t = " ".join(f"word{j}, of" for j in range(k % 7, k % 7 + 5))
        assert encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_costs_are_even():
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int) + 1, 9000)
    pieces = packing.assign(sizes)
    filled, cost = Counter(), Counter()
    for _, _, n, q, _ in pieces:
        filled[q] += n
        cost[q] += n + n * n / packing.EVEN_AT
    assert sorted(filled.values(), reverse=True) == packing.capacities(int(sizes.sum()), packing.LENGTH)
    full = np.array([cost[q] for q, n in filled.items() if n == packing.LENGTH])
    dealt = full[full < packing.LENGTH * (1 + packing.LENGTH / packing.EVEN_AT)]
    assert dealt.max() < 1.35 * dealt.mean()
    assert len(pieces) < 1.2 * (len(sizes) + (sizes // packing.LENGTH).sum())  # few are cut that need not be


def test_registered_packing(spark, sf_dir):
    rows = catalog.QUERIES["op11_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    covered = Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


# the filter audit

LABELS = "doc_id long, quality int, toxic int, part string"


def audited(rows, labels):
    """``rows``: (doc_id, lang, text)."""
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, _ in labels if i is not None and t == 1}
    least: dict = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, lang, t in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        f |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((i, lang or "", {k for k, v in f.items() if v}))
    out, shares = [], Counter()
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                kept = [(i, f) for i, f in left if x not in f]
                shares[part, x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                out.append([part, order, k + 1, len(kept), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
                left = kept
    return sorted(tuple(r) + (shares[r[0], r[1][r[2] - 1]],) for r in out)


def test_filter_audit(spark, odd):  # noqa: F811
    more = [(900 + k, t, "en") for k, t in enumerate(["w%d " % k * 1 for k in range(3)] + [" ".join(f"w{j}" for j in range(250)), " ".join(f"w{j} #" for j in range(150)), " ".join(f"W{j}" for j in range(201)), "A" + "é" * 32, "A" + "é" * 33])]
    table = odd.select("doc_id", "text", "lang", F.lit(7).alias("mask"), F.lit("x").alias("part"), F.lit(1).alias("good")).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.lang, r.text) for r in table.collect()]
    labels = [(k, k % 2, k % 3 == 0, "p") for k in range(0, 60, 2)] + [(4, 1, None, "p"), (4, None, 1, "p"), (None, 1, 1, "p"), (5000, 1, 1, "p"), (901, 1, 1, None)]
    labels = [(i, q, int(t) if t is not None else None, p) for i, q, t, p in labels]
    got = filter_audit.audit(table, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == audited(rows, labels)


def test_filter_audit_empty(spark, none, odd):  # noqa: F811
    no_labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).collect() == []
    rows = filter_audit.audit(odd, no_labels).collect()
    assert rows and not any(r.good_lost or r.toxic_lost for r in rows)


# the divergence audit


def diverging(rows, least):
    """``rows``: (lang, source, text)."""
    count, docs_with = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(ts)
        docs_with[lang].update(set(ts))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs_with[lang].items() if n >= least]
        whole = Counter()
        for s in names:
            whole.update({t: count[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(count[lang, s]) for s in names}, shares(whole)
        for s in names:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 10_000])
@pytest.mark.parametrize("sizes", [(128, 2048), (1, 7), (2, 3)])
def test_divergence(odd, least, sizes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(divergence, "SOURCES", sizes[0])
    monkeypatch.setattr(divergence, "TERMS", sizes[1])
    more = odd.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))
    table = odd.unionByName(more).withColumns({"term": F.lit("t"), "value": F.lit(3), "rank": F.lit(1), "chunk": F.lit(0)})
    rows = [(r.lang, r.source, r.text) for r in table.collect()]
    assert sorted(map(tuple, divergence.divergence(table, least).collect())) == diverging(rows, least)


def test_divergence_sends_sums(odd, monkeypatch):  # noqa: F811
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "CELLS", 1)
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(map(tuple, divergence.divergence(odd, 2).collect())) == diverging(rows, 2)


def test_divergence_empty(none):  # noqa: F811
    assert divergence.divergence(none).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    count, total = rng.integers(0, 1 << 40, 200), rng.integers(1 << 40, 1 << 53, 200)
    assert divergence.scaled(count, total).tolist() == [1 + 1_000_000_000 * int(a) // int(b) for a, b in zip(count, total)]
