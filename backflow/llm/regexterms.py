"""Trigrams that every match of a regex must hold, derived from its parsed form."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product
from re import _constants as sre, _parser

#: Strings, or alternatives, beyond which a part of a regex is no longer followed exactly. Fewer conditions only make more candidates.
MOST = 64

Terms = frozenset  # of alternatives, each a frozenset of trigrams that all must occur; an empty alternative asks for nothing
ALL: Terms = frozenset([frozenset()])


def mandatory(pattern: str) -> list[tuple[str, ...]]:
    """Alternatives of trigrams of the lower-cased text: whatever the regex matches holds all trigrams of one of them. Empty if nothing is mandatory."""
    exact, terms = _sequence(_parser.parse(pattern))
    terms = _both(terms, _grams(exact)) if exact is not None else terms
    return [] if frozenset() in terms else sorted(tuple(sorted(x)) for x in terms)


def _grams(strings: Iterable[str]) -> Terms:
    return _least(frozenset(text[k : k + 3] for k in range(len(text) - 2)) for text in strings)


def _least(alternatives: Iterable[frozenset]) -> Terms:
    """Alternatives without those that ask for all that another one asks for."""
    kept: list[frozenset] = []
    for x in sorted(set(alternatives), key=len):
        if not any(y <= x for y in kept):
            kept.append(x)
    return frozenset(kept)


def _both(a: Terms, b: Terms) -> Terms:
    if a == ALL or b == ALL or len(a) * len(b) > MOST:
        # One of two conditions will do; that with fewer alternatives says more.
        return min((x for x in (a, b) if x != ALL), key=len, default=ALL)
    return _least(x | y for x, y in product(a, b))


def _sequence(items) -> tuple[frozenset | None, Terms]:
    """What a sequence matches: all its strings, if they are few, and the terms of the parts that are not among these."""
    run, terms, whole = frozenset([""]), ALL, True
    for op, value in items:
        exact, inner = _item(op, value)
        terms = _both(terms, inner)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(x + y for x, y in product(run, exact))
            continue
        terms, whole = _both(terms, _grams(run)), False
        run = exact if exact is not None else frozenset([""])
    return (run, terms) if whole else (None, _both(terms, _grams(run)))


def _item(op, value) -> tuple[frozenset | None, Terms]:
    if op is sre.LITERAL:
        return _characters([value])
    if op is sre.IN:
        return _characters(_members(value))
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # no width
        return frozenset([""]), ALL
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.ATOMIC_GROUP:
        return _sequence(value)
    if op is sre.BRANCH:
        return _branch([_sequence(x) for x in value[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return _repeat(*value)
    return None, ALL


def _characters(codes: Iterable[int] | None) -> tuple[frozenset | None, Terms]:
    """Lower-casing beyond ASCII can depend on what stands beside a letter; such letters are not followed."""
    if codes is None or any(c > 127 for c in codes):
        return None, ALL
    return frozenset(chr(c).lower() for c in codes), ALL


def _members(items) -> list[int] | None:
    codes: list[int] = []
    for op, value in items:
        if op is sre.LITERAL:
            codes.append(value)
        elif op is sre.RANGE and value[1] - value[0] < MOST:
            codes.extend(range(value[0], value[1] + 1))
        else:
            return None
    return codes if len({chr(c).lower() for c in codes}) <= MOST // 8 else None


def _branch(ways: list[tuple[frozenset | None, Terms]]) -> tuple[frozenset | None, Terms]:
    if all(exact is not None for exact, _ in ways) and all(terms == ALL for _, terms in ways):
        strings = frozenset().union(*[exact for exact, _ in ways])
        if len(strings) <= MOST:
            return strings, ALL
    joined = _least(x for exact, terms in ways for x in (_both(terms, _grams(exact)) if exact is not None else terms))
    return None, joined if len(joined) <= MOST else ALL


def _repeat(least: int, most: int, items) -> tuple[frozenset | None, Terms]:
    exact, terms = _sequence(items)
    if least == 0:
        return (exact | {""}, ALL) if exact is not None and most == 1 and terms == ALL else (None, ALL)
    once = _both(terms, _grams(exact)) if exact is not None else terms
    if exact is not None and least == most and terms == ALL and len(exact) ** least <= MOST:
        return frozenset("".join(x) for x in product(exact, repeat=least)), ALL
    return None, once
