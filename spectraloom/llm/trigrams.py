"""Boolean trigram queries from regular expressions.

A query is True (no constraint), a trigram, or ("and" | "or", [queries]): every
text that the expression matches satisfies it once both are in lower case.
"""

from __future__ import annotations

import itertools
from re import _constants as C
from re import _parser as P

#: A set of alternative strings larger than this becomes a constraint and is forgotten.
MOST_STRINGS = 64
#: A character class of more members is any character.
MOST_MEMBERS = 8


def both(a, b):
    return _join("and", a, b, neutral=True)


def either(a, b):
    if a is True or b is True:
        return True
    return _join("or", a, b, neutral=None)


def _join(kind, a, b, neutral):
    parts = []
    for x in (a, b):
        if x is neutral:
            continue
        parts += x[1] if isinstance(x, tuple) and x[0] == kind else [x]
    parts = list(dict.fromkeys(_key(p) for p in parts))
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, [_unkey(p) for p in parts])


def _key(x):
    return (x[0], tuple(_key(y) for y in x[1])) if isinstance(x, tuple) else x


def _unkey(x):
    return (x[0], [_unkey(y) for y in x[1]]) if isinstance(x, tuple) else x


def of_strings(strings: set[str]):
    """Some of the strings occurs, as a whole."""
    if any(len(s) < 3 for s in strings):
        return True
    query = None
    for s in sorted(strings):
        q = True
        # those that cover the string: the others add postings and hardly a decision
        for i in sorted({*range(0, len(s) - 2, 3), len(s) - 3}):
            q = both(q, s[i : i + 3])
        query = q if query is None else either(query, q)
    return True if query is None else query


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_MEMBERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the nodes match or None, query)"""
    exact: set[str] | None = {""}
    query: object = True
    whole = True

    def flush():
        nonlocal exact, query
        query = both(query, of_strings(exact)) if exact else query
        exact = {""}

    for op, value in nodes:
        strings, inner = _node(op, value)
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a, b in itertools.product(exact, strings)}
            continue
        flush()
        whole = False
        if strings is not None:
            exact = strings
        else:
            query = both(query, inner)
    if whole:
        return exact, of_strings(exact)
    flush()
    return None, query


def _node(op, value) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(value).lower()}, True
    if op is C.IN:
        return _members(value), True
    if op is C.SUBPATTERN:
        return _walk(value[3])
    if op is C.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), True
        query = parts[0][1]
        for _, q in parts[1:]:
            query = either(query, q)
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return {"".join(x) for x in itertools.product(strings, repeat=low)}, True
        return None, query if low else True
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """The query of a pattern; True if no trigram is mandatory."""
    return _walk(P.parse(pattern))[1]


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))
