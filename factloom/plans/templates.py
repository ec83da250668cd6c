"""Parameterised query texts and their grids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame

from factloom.plans import sparql

#: Texts by name; ``{name}`` is a parameter.
TEMPLATES = {
    "lookup": "SELECT ?p ?o WHERE {{ {subject} ?p ?o }}",
    "by_relation": "SELECT ?s ?o WHERE {{ ?s {relation} ?o }}",
    "two_hops": "SELECT ?s ?z WHERE {{ ?s {relation} ?y . ?y {next} ?z }}",
    "range": "SELECT ?s ?v WHERE {{ ?s {relation} ?v FILTER(?v >= {low} && ?v < {high}) }}",
    "count_by_object": "SELECT ?o (COUNT(?s) AS ?n) WHERE {{ ?s {relation} ?o }} GROUP BY ?o HAVING(?n > {least})",
    "mean": "SELECT (AVG(?v) AS ?mean) WHERE {{ ?s {relation} ?v }}",
    "top": "SELECT ?s ?v WHERE {{ ?s {relation} ?v FILTER(?v > 0) }} ORDER BY DESC(?v) LIMIT {k}",
    # The eight contextual workloads as texts over described facts.
    "around_entity": "SELECT ?f ?p WHERE {{ ?f ?p {entity} . ?f confidence ?c FILTER(?c >= {least}) }}",
    "high_arity": "SELECT ?f ?b ?c WHERE {{ ?f a {relation} ; arg0 {first} ; arg1 ?b ; arg2 ?c }}",
    "during": "SELECT ?f WHERE {{ ?f validStart ?s ; validEnd ?e FILTER(?s < {end} && ?e > {start}) }}",
    "mean_during": "SELECT (COUNT(?f) AS ?n) (AVG(?v) AS ?mean) WHERE {{ ?f validStart ?s ; validEnd ?e ; {slot} ?v FILTER(?s < {end} && ?e > {start}) }}",
    "derived": "SELECT ?d ?s ?c WHERE {{ ?d derived ?s . ?d confidence ?c FILTER(?c <= {most}) }} ORDER BY ?d",
    "assignments": "SELECT ?x ?e ?v WHERE {{ ?f context ?x ; subject ?e ; {slot} ?v }} ORDER BY ?x ?e ?v",
    "agreed": "SELECT ?e ?v (COUNT(DISTINCT ?x) AS ?n) WHERE {{ ?f context ?x ; subject ?e ; {slot} ?v }} GROUP BY ?e ?v HAVING(?n >= {least})",
    "mixed": "SELECT ?n ?d ?sure WHERE {{ {{ SELECT ?n WHERE {{ ?n subject {subject} }} }} {{ SELECT ?n WHERE {{ ?n validStart ?s ; validEnd ?e FILTER(?s < {end} && ?e > {start}) }} }}"
    " OPTIONAL {{ ?n derived ?d }} BIND(EXISTS {{ ?n confidence ?c FILTER(?c >= {least}) }} AS ?sure) }}",
    "without": "SELECT ?f WHERE {{ ?f a {relation} FILTER NOT EXISTS {{ ?f {slot} '{value}' }} FILTER EXISTS {{ ?f {having} ?x }} }}",
    "optional": "SELECT ?s ?x WHERE {{ ?s {relation} ?o OPTIONAL {{ ?o {next} ?x }} }}",
}
_SAFE = re.compile(r"[\w:/#.+-]+")


def render(name: str, **values) -> str:
    """A template's text; values are single terms, never syntax."""
    text = TEMPLATES[name]
    wanted = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    if wanted != set(values):
        raise ValueError(f"{name} takes {sorted(wanted)}")
    for k, v in values.items():
        if not _SAFE.fullmatch(str(v)):
            raise ValueError(f"{k} is no single term: {v!r}")
    return text.format(**values)


def grid(name: str, **choices: Sequence) -> Iterator[tuple[Mapping, str]]:
    """(parameters, text) for every combination of the choices."""
    for combo in product(*choices.values()):
        values = dict(zip(choices, combo))
        yield values, render(name, **values)


def run(statements: DataFrame, name: str, numbers: Sequence[str] = (), **values) -> DataFrame:
    return sparql.run(statements, render(name, **values), numbers=numbers)
