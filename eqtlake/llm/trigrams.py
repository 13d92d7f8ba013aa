"""Boolean trigram queries derived from regular expressions.

A query is ``None`` (matches anything) or a list of alternatives, each a set of
trigrams that must all occur. Texts and patterns are compared in lower case, so
a query never excludes a text in which the pattern matches.
"""

from __future__ import annotations

import re
from itertools import product

_parser = re._parser
#: Beyond so many strings a set of exact strings is turned into a query.
MAX_EXACT = 32

Query = list[frozenset[str]] | None


def all_of(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return list(dict.fromkeys(x | y for x, y in product(a, b)))


def any_of(a: Query, b: Query) -> Query:
    """Alternatives that imply another one are left out."""
    if a is None or b is None:
        return None
    parts = list(dict.fromkeys([*a, *b]))
    return [x for x in parts if not any(y < x for y in parts)]


def of_strings(strings: set[str]) -> Query:
    """Any of ``strings`` occurs."""
    query: Query = []
    for s in sorted(strings):
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        query = any_of(query, [grams] if grams else None)
    return query


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The exact strings a node matches, if few, else the query it implies."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 6 else (None, None)
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "ATOMIC_GROUP":
        return _sequence(arg)
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(exact is not None for exact, _ in parts):
            joined = set().union(*(exact for exact, _ in parts))
            if len(joined) <= MAX_EXACT:
                return joined, None
        query: Query = []
        for exact, sub in parts:
            query = any_of(query, of_strings(exact) if exact is not None else sub)
        return None, query
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        exact, query = _sequence(body)
        if exact is not None and high == 1:
            return exact | ({""} if low == 0 else set()), None
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * low}, None
        if low == 0:
            return None, None
        return None, of_strings(exact) if exact is not None else query
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    exact: set[str] = {""}
    query: Query = None
    whole = True
    for op, arg in nodes:
        strings, sub = _node(op, arg)
        if strings is not None and len(exact) * len(strings) <= MAX_EXACT:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        whole = False
        query = all_of(query, of_strings(exact))
        query = all_of(query, sub)
        exact = strings if strings is not None else {""}
    return (exact, None) if whole else (None, all_of(query, of_strings(exact)))


def trigram_query(pattern: str) -> Query:
    """The query of ``pattern``; None if no trigram is mandatory."""
    exact, query = _sequence(_parser.parse(pattern))
    return of_strings(exact) if exact is not None else query
