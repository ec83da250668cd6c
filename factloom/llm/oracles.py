"""SQL (DuckDB) that states the results of the licence scan and of source mixing, built from their own fixed values."""

from __future__ import annotations

from factloom.llm import licenses, mixing

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan() -> str:
    vocab = licenses.vocabulary()
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    n = lambda w: vocab.index(w) + 1

    def places(parts: list[tuple[int, str]]) -> str:
        tests = " and ".join(f"i + {k} >= 0 and ws[i + {k} + 1] = '{w}'" for k, w in parts)
        return f"list_filter(range(0, len(ws)), lambda i: {tests})"

    bases = [places(list(enumerate(p.split()))) for p in licenses.BASE]
    covers = []
    for _, text, must in licenses.TEMPLATES:
        entries, at = licenses._entries(text), licenses._offset(text.split(), must.split())
        need = list(enumerate(must.split()))
        share = " + ".join(f"case when s + {k - at} >= 0 and ws[s + {k - at} + 1] = '{w}' then idf[{n(w)}] / ({' + '.join(f'idf[{n(x)}]' for _, x in entries)}) else 0 end" for k, w in entries)
        covers.append(f"coalesce(list_max(list_transform({places(need)}, lambda s: {share})), 0)")
    listed = ", ".join(f"'{w}'" for w in vocab)
    has = ", ".join(f"case when len(b{k}) > 0 then '{label}' end" for k, label in enumerate(licenses.BASE.values()))
    more = ", ".join(f"case when c{k} >= {licenses.COVERAGE} then '{label}' end" for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{xs}], lambda x: x is not null))), ',')"
    every = " || ".join(f"b{k}" for k in range(len(bases)))
    best = ", ".join(f"c{k}" for k in range(len(covers)))
    return f"""
    with w as (select doc_id, regexp_extract_all({ASCII_LOWER}, '{words}') as ws from documents),
    v as (select unnest([{listed}]) as word, unnest(range(1, {len(vocab) + 1})) as k),
    f as (select k, ln(((select count(*) from w) + 1) / ((select count(*) from w where list_contains(ws, word)) + 1)) + 1e-9 as idf from v),
    idf as (select list(idf order by k) as idf from f),
    p as (select doc_id, len(ws) as n_words, {", ".join(f"{b} as b{k}" for k, b in enumerate(bases))}, {", ".join(f"{c} as c{k}" for k, c in enumerate(covers))} from w, idf)
    select doc_id, n_words, len({every}) as n_base, list_min({every}) as first_word, list_max({every}) as last_word,
           {joined(has)} as base_labels, {joined(has + ", " + more)} as labels,
           case when len({every}) > 0 then 1.0::double else round(least(greatest({best}), 1.0)::double, 6) end as score
    from p
    """


def source_mixing(rate: float = mixing.RATE, seed: int = 17) -> str:
    dims = mixing.TEMPER
    keys = "source, lang, topic"
    out = [
        rf"r as (select doc_id, coalesce('=' || source, 'null') as source, coalesce('=' || lang, 'null') as lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens from documents)",
        "m as (select *, case when tokens < 50 then 'note' when tokens < 400 then 'article' else 'longform' end as topic from r)",
        f"cells as (select {keys}, sum(tokens)::double as w0 from m group by all)",
        "t as (select sum(w0) as total from cells)",
    ]
    for d, power in dims.items():
        out.append(f"n_{d} as (select sum(pow(m / total, {power})) as norm from (select sum(w0) as m from cells group by {d}), t where m > 0)")
    targets = ", ".join(f"pow(sum(w0) over (partition by {d}) / total, {p}) / (select norm from n_{d}) * total as to_{d}" for d, p in dims.items())
    out.append(f"x0 as materialized (select {keys}, w0, w0 as w, {targets} from cells, t)")
    carried, k = ", ".join(f"to_{d}" for d in dims), 0
    for _ in range(mixing.ROUNDS):
        for d in dims:
            out.append(f"x{k + 1} as materialized (select {keys}, w0, case when sum(w) over (partition by {d}) > 0 then w * to_{d} / sum(w) over (partition by {d}) else 0.0 end as w, {carried} from x{k})")
            k += 1
    out.append(f"y as (select {keys}, w0, w, case when w0 > 0 then w / w0 else 0.0 end as ratio from x{k})")
    out.append(f"f0 as (select {rate}::double as f)")
    for step in range(mixing.CALIBRATIONS):
        out.append(
            f"g{step} as (select f, coalesce(sum(w0) filter (ratio * f >= 1), 0.0) as at_one, coalesce(sum(w) filter (ratio * f < 1), 0.0) as rest from y, f{step} group by f), "
            f"f{step + 1} as (select case when rest = 0 then f else greatest(f, ({rate} * total - at_one) / rest) end as f from g{step}, t)"
        )
    out.append(f"p as (select {keys}, case when w0 > 0 then least(1.0, ratio * f) else {rate} end as p from y, f{mixing.CALIBRATIONS})")
    chance = f"('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{seed}'), 1, 13))::bigint / {float(1 << 52)}"
    return f"with {', '.join(out)} select doc_id, {keys}, tokens, round(p, 6) as p, {chance} < p as kept from m join p using ({keys})"


def substring_dedup(window: int) -> str:
    """Every window by its words; the first place of each stays."""
    return rf"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    u as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as p from w),
    x as (select doc_id, ws, unnest(range(0, len(ws) - {window - 1})) as p from w where len(ws) >= {window}),
    r as (select doc_id, p, row_number() over (partition by array_to_string(ws[p + 1 : p + {window}], ' ') order by doc_id, p) > 1 as again from x),
    c as (select doc_id, p, word, coalesce(max(again::int) over (partition by doc_id order by p rows between {window - 1} preceding and current row), 0) = 1 as gone from u left join r using (doc_id, p))
    select doc_id, count(word) as n_words, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by p) filter (not gone), '')) as kept_sha256
    from documents left join c using (doc_id) group by doc_id
    """


def near_dedup(shingle: int, percent: int) -> str:
    """Candidates share one of the rarest shingles of both, as many as a pair at the threshold cannot all differ in; full sets decide."""
    need = f"(n * {percent} + 99) // 100"
    return rf"""
    with recursive w as (select doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select distinct doc_id, array_to_string(ws[p + 1 : p + {shingle}], ' ') as g from (select doc_id, ws, unnest(range(0, len(ws) - {shingle - 1})) as p from w where len(ws) >= {shingle})
          union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and {shingle - 1}),
    d as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by doc_id),
    k as (select h, min(doc_id) as c, min(n) as n from d group by h),
    t as (select c, n, g, row_number() over (partition by c order by f, g) as rank from k join s on doc_id = c join (select g, count(*) as f from s group by g) using (g)),
    p as (select distinct a.c as a, b.c as b from t a join t b on a.g = b.g and a.c < b.c where a.rank <= a.n - ({need.replace("n ", "a.n ")}) + 1 and b.rank <= b.n - ({need.replace("n ", "b.n ")}) + 1 and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
    l as (select a, b from (select p.a, p.b, x.n as na, y.n as nb, count(*) as common from p join t x on x.c = p.a join t y on y.c = p.b and y.g = x.g group by all) where 100 * common >= {percent} * (na + nb - common)),
    e as (select a, b from l union all select b, a from l),
    r as (select c as x, c as y from k union select r.x, e.b from r join e on e.a = r.y),
    m as (select x as c, min(y) as component_id from r group by x)
    select doc_id, coalesce(d.n, 0) as n_shingles, coalesce(m.component_id, doc_id) as component_id, doc_id = coalesce(m.component_id, doc_id) as kept
    from documents left join d using (doc_id) left join k on k.h = d.h left join m on m.c = k.c
    """


def contamination(shingle: int, least: float) -> str:
    """All item-sized windows that hold a shingle of the item, by weighted Jaccard; the first of the best."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    with d as (select doc_id, regexp_extract_all({ASCII_LOWER}, '{word}') as ws from documents),
    i as (select item_id, regexp_extract_all({ASCII_LOWER}, '{word}') as ws from benchmark),
    sizes as (select distinct least({shingle}, len(ws)) as size from i where len(ws) > 0),
    dg as (select doc_id, len(ws) as nd, size, p, array_to_string(ws[p + 1 : p + size], ' ') as g from (select doc_id, ws, size, unnest(range(0, len(ws) - size + 1)) as p from d, sizes where len(ws) >= size)),
    ig as (select item_id, ni, size, g, count(*) as c from (select item_id, len(ws) as ni, size, array_to_string(ws[p + 1 : p + size], ' ') as g from (select item_id, ws, least({shingle}, len(ws)) as size, unnest(range(0, len(ws) - least({shingle}, len(ws)) + 1)) as p from i where len(ws) > 0)) group by all),
    hits as (select doc_id, item_id, nd, ni, size, p, g, c from dg join ig using (size, g)),
    z as (select distinct doc_id, item_id, nd, ni, size, unnest(range(greatest(0, p - (ni - size)), least(p, greatest(nd - ni, 0)) + 1)) as s from hits),
    m as (select doc_id, item_id, nd, ni, size, s, g, least(count(*), min(c)) as common from z join hits using (doc_id, item_id, nd, ni, size) where p between s and s + least(ni, nd) - size group by all),
    j as (select doc_id, item_id, s, least(nd, ni) as n_words, sum(common) as b, least(nd, ni) - size + 1 + ni - size + 1 as total from m group by doc_id, item_id, nd, ni, size, s),
    v as (select *, b::double / (total - b)::double as similarity from j)
    select doc_id, item_id, s as first_word, n_words, similarity from v where similarity >= {least}
    qualify row_number() over (partition by doc_id, item_id order by similarity desc, s) = 1
    """


def filter_audit() -> str:
    """Every order applied to every cell of five failures."""
    steps = {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}
    listed = ", ".join(f"('{f}', {1 << k})" for f, k in steps.items())
    return rf"""
    with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by text) as first from d),
    m as (select doc_id, part,
                 (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
                 + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask from w),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
    f as (select * from (values {listed}) as v (letter, bit)),
    o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from f a, f b, f c, f d, f e
          where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    s as (select filter_order, i as step, substr(filter_order, i, 1) as letter from o, unnest(range(1, 6)) as t (i)),
    b as (select filter_order, step, s.letter, bit, coalesce(sum(bit) over (partition by filter_order order by step rows between unbounded preceding and 1 preceding), 0)::int as before from s join f using (letter)),
    r as (select part, filter_order, step, letter,
                 sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & before = 0 and mask & bit > 0) as removed,
                 sum(n) filter (mask & before > 0 and mask & bit > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
                 sum(good) filter (mask & before = 0 and mask & bit > 0) as good_lost, sum(toxic) filter (mask & before = 0 and mask & bit > 0) as toxic_lost
          from c, b group by all)
    select part, filter_order, cast(step as int) as step, {", ".join(f"cast(coalesce({x}, 0) as bigint) as {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley
    from r
    """


def divergence(least: int, top: int) -> str:
    """Every group by every kept term of its language."""
    return rf"""
    with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws, row_number() over () as i from documents),
    u as (select lang, source, i, unnest(ws) as term from d),
    v as (select lang, term from u group by all having count(distinct i) >= {least}),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as n from u join v using (lang, term) group by all),
    x as (select lang, source, term, coalesce(n, 0) as n from g join v using (lang) left join c using (lang, source, term)),
    t as (select *, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as kept,
                 sum(n) over (partition by lang, term) as whole, sum(n) over (partition by lang) as every from x),
    p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)::hugeint) // (total + 5 * kept) as p, 1 + (1000000000 * (whole + 5)::hugeint) // (every + 5 * kept) as q from t),
    f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
          union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
    select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
    from r qualify part = 'pair' or rank <= {top}
    """
