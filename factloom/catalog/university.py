"""The fourteen university queries over generated universities, and the SQL for both."""

from __future__ import annotations

from factloom.catalog.registry import query
from factloom.functions.staging import cut
from factloom.operators import triples
from factloom.plans import sparql
from factloom.sources import generators

SIZE = {"universities": 2, "departments": 3, "professors": 4, "students": 20, "courses": 6, "seed": 42}

# The selected variables and patterns of the fourteen queries, in the generator's names.
TEXTS = {
    "q1": ("x", "?x rdf:type GraduateStudent . ?x takesCourse univ0/dept0/course0"),
    "q2": ("x y z", "?x rdf:type GraduateStudent . ?y rdf:type University . ?z rdf:type Department . ?x memberOf ?z . ?z subOrganizationOf ?y . ?x undergraduateDegreeFrom ?y"),
    "q3": ("x", "?x rdf:type Publication . ?x publicationAuthor univ0/dept0/professor0"),
    "q4": ("x y1 y2 y3", "?x rdf:type Professor . ?x worksFor univ0/dept0 . ?x name ?y1 . ?x emailAddress ?y2 . ?x telephone ?y3"),
    "q5": ("x", "?x rdf:type Person . ?x memberOf univ0/dept0"),
    "q6": ("x", "?x rdf:type Student"),
    "q7": ("x y", "?x rdf:type Student . ?y rdf:type Course . ?x takesCourse ?y"),
    "q8": ("x y z", "?x rdf:type Student . ?y rdf:type Department . ?x memberOf ?y . ?x emailAddress ?z"),
    "q9": ("x y z", "?x rdf:type Student . ?y rdf:type Faculty . ?z rdf:type Course . ?x advisor ?y . ?x takesCourse ?z"),
    "q10": ("x", "?x rdf:type Student . ?x takesCourse univ0/dept0/course0"),
    "q11": ("x", "?x rdf:type ResearchGroup . ?x subOrganizationOf univ0"),
    "q12": ("x", "?x rdf:type Chair . ?x worksFor univ0/dept0"),
    "q13": ("x", "?x rdf:type Person . ?x doctoralDegreeFrom univ0"),
    "q14": ("x", "?x rdf:type UndergraduateStudent . ?x memberOf univ0/dept0"),
}


def _facts_sql() -> str:
    z = SIZE
    drawn = lambda x, n, what: f"(('0x' || substr(md5({x} || ':{what}:{z['seed']}'), 1, 8))::bigint % {n})"
    people = lambda kind, n: f"(select d, u, k, d || '/{kind}' || k as x from dept, range({n}) r(k))"
    prof, stud, course = people("professor", z["professors"]), people("student", z["students"]), people("course", z["courses"])
    typed = lambda name, rows: f"select x, 'rdf:type', '{name}' from {rows}"
    parts = ["select d, 'rdf:type', 'Department' from dept", "select distinct u, 'rdf:type', 'University' from dept"]
    parts += [typed(n, prof) for n in ("Professor", "Faculty", "Person")] + [typed(n, stud) for n in ("Student", "Person")]
    parts += [typed("Chair", prof) + " where k = 0", typed("GraduateStudent", stud) + " where k % 4 = 0", typed("UndergraduateStudent", stud) + " where k % 4 <> 0", typed("Course", course)]
    parts += [f"select x || '/paper', 'rdf:type', 'Publication' from {prof}", "select d || '/group', 'rdf:type', 'ResearchGroup' from dept"]
    parts += [f"select x, 'emailAddress', x || '@example.org' from {rows}" for rows in (prof, stud)]
    parts += [f"select x, 'name', 'Professor ' || k from {prof}", f"select x, 'telephone', '555-' || k from {prof}"]
    parts += ["select d || '/group', 'subOrganizationOf', u from dept", "select d, 'subOrganizationOf', u from dept"]
    parts += [f"select x, '{p}', 'univ' || {drawn('x', z['universities'], 'degree')} from {rows}" for p, rows in (("undergraduateDegreeFrom", stud + " where k % 4 = 0"), ("doctoralDegreeFrom", prof))]
    parts += [f"select x, 'worksFor', d from {prof}", f"select x, 'headOf', d from {prof} where k = 0", f"select x, 'memberOf', d from {stud}"]
    for p, rows, kind, n, what in (("teacherOf", prof, "course", z["courses"], "teach"), ("takesCourse", stud, "course", z["courses"], "take"), ("advisor", stud, "professor", z["professors"], "advise")):
        parts.append(f"select x, '{p}', d || '/{kind}' || {drawn('x', n, what)} from {rows}")
    parts.append(f"select x || '/paper', 'publicationAuthor', x from {prof}")
    dept = f"dept as (select 'univ' || i as u, 'univ' || i || '/dept' || j as d from range({z['universities']}) a(i), range({z['departments']}) b(j))"
    return f"{dept}, st(s, p, o) as ({' union all '.join(parts)})"


def _patterns_sql(names: str, text: str) -> str:
    """A basic graph pattern as joins of the statements, one alias a pattern."""
    tests, seen, froms = [], {}, []
    for k, pattern in enumerate(text.split(" . ")):
        froms.append(f"st t{k}")
        for part, term in zip("spo", pattern.split()):
            if not term.startswith("?"):
                tests.append(f"t{k}.{part} = '{term}'")
            elif term in seen:
                tests.append(f"t{k}.{part} = {seen[term]}")
            else:
                seen[term] = f"t{k}.{part}"
    return f"select {', '.join(f'{seen[chr(63) + n]} as {n}' for n in names.split())} from {', '.join(froms)} where {' and '.join(tests)}"


def _register(name: str, names: str, text: str) -> None:
    @query(f"university_{name}", f"with {_facts_sql()} {_patterns_sql(names, text)}")
    def run(s, d):
        st = cut(triples.statements(generators.university(s, **SIZE)), "university")
        return sparql.run(st, f"SELECT {' '.join('?' + n for n in names.split())} WHERE {{ {text} }}")


for _name, (_names, _text) in TEXTS.items():
    _register(_name, _names, _text)
