"""From a regex to the Boolean query over trigrams that every text with a match satisfies.

A query is True (any text), a trigram, or ("and" | "or", parts). Trigrams are of texts in lower case.
"""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser as parser

Query = bool | str | tuple
MOST_STRINGS, MOST_CHARS = 64, 4


def _join(kind: str, parts: list[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= set(p[1])
        else:
            flat.add(p)
    other = "or" if kind == "and" else "and"
    kept = [p for p in flat if not (isinstance(p, tuple) and p[0] == other and any(q != p and (q in p[1] or isinstance(q, tuple) and q[0] == other and set(q[1]) < set(p[1])) for q in flat))]
    if not kept:
        return True
    return kept[0] if len(kept) == 1 else (kind, tuple(sorted(kept, key=repr)))


def _of_strings(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[k : k + 3] for k in range(len(s) - 2)]) if len(s) >= 3 else True for s in strings])


def _chars(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 64:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARS else None


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """All strings that the part matches (None: too many), and the query if they are too many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        return _chars(arg), True
    if op is sre.AT:
        return {""}, True
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        branches = [_sequence(b) for b in arg[1]]
        if all(s is not None for s, _ in branches) and len(union := set().union(*(s for s, _ in branches))) <= MOST_STRINGS:
            return union, True
        return None, _join("or", [q if s is None else _of_strings(s) for s, q in branches])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, query = _sequence(body)
        if strings is not None and most is not sre.MAXREPEAT and most <= 4:
            all_ = {"".join(x) for n in range(least, most + 1) for x in product(strings, repeat=n)} if len(strings) ** most <= MOST_STRINGS else None
            if all_ is not None:
                return all_, True
        if not least:
            return None, True
        return None, query if strings is None else _of_strings({"".join(x) for x in product(strings, repeat=min(least, 3))}) if len(strings) ** min(least, 3) <= MOST_STRINGS else True
    return None, True


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, parts, exact = {""}, [], True
    for op, arg in items:
        strings, query = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        parts += [_of_strings(run), query]
        run = strings if strings is not None else {""}
    if exact:
        return run, True
    return None, _join("and", [*parts, _of_strings(run)])


def query_of(regex: str) -> Query:
    strings, query = _sequence(parser.parse(regex))
    return query if strings is None else _of_strings(strings)


def grams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(grams_of(p) for p in query[1])) if isinstance(query, tuple) else set()


def holds(query: Query, grams: set[str]) -> bool:
    if isinstance(query, tuple):
        return (all if query[0] == "and" else any)(holds(p, grams) for p in query[1])
    return query is True or query in grams
