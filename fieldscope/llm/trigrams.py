"""Boolean trigram queries of regular expressions.

A query says which trigrams a text must hold if a pattern matches in it: ``True`` (nothing is required), a trigram, or
``("and" | "or", parts)``. For each part of a pattern four things are worked out from those of its parts: the set of
all strings it matches, if that is small; else sets of beginnings and ends, one of which each match has; and a
query of what stands between. Letters are in lower case, for texts in lower case.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

MOST = 64  # strings kept of a part; a larger set becomes a query of its trigrams, with beginnings and ends
CLASS = 8  # a class of more characters counts as any character


def both(*queries):
    return _joined("and", False, queries)


def either(*queries):
    return _joined("or", True, queries)


def _joined(how, absorbing, queries):
    """Parts of one kind in one list; an "and" drops True, an "or" with True is True; what another part implies goes."""
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == how else {q}
    if True in parts and absorbing:
        return True
    parts.discard(True)
    other = "or" if how == "and" else "and"
    terms = lambda q: q[1] if isinstance(q, tuple) and q[0] == other else frozenset([q])
    parts = {q for q in parts if not any(p != q and terms(p) < terms(q) for p in parts)}
    if not parts:
        return True
    return parts.pop() if len(parts) == 1 else (how, frozenset(parts))


def of_strings(strings) -> object:
    """A text that holds one of the strings holds all trigrams of one; a shorter string requires nothing."""
    return either(*[both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


@dataclass(frozen=True)
class Part:
    exact: frozenset | None  # all strings it matches, or None
    first: frozenset  # each match begins with one of these
    last: frozenset  # and ends with one
    query: object = True


def _exact(strings) -> Part:
    held = frozenset(strings)
    return Part(held, held, held)


NOTHING = _exact([""])
ANY = Part(None, frozenset([""]), frozenset([""]))


def _few(strings, cut) -> tuple[frozenset, object]:
    """The strings, cut to two characters if there are too many of them, or to nothing; and the query of what was cut."""
    if len(strings) <= MOST:
        return frozenset(strings), True
    short = frozenset(map(cut, strings))
    return (short if len(short) <= MOST else frozenset([""])), of_strings(strings)


def _open(part: Part) -> Part:
    """The part without its set of all strings."""
    if part.exact is None:
        return part
    return Part(None, part.first, part.last, both(part.query, of_strings(part.exact)))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _exact(x + y for x, y in product(a.exact, b.exact))
    seam = of_strings([x + y for x, y in product(a.last, b.first)])
    first, cut_first = _few([x + y for x, y in product(a.exact, b.first)], lambda s: s[:2]) if a.exact is not None else (a.first, True)
    last, cut_last = _few([x + y for x, y in product(a.last, b.exact)], lambda s: s[-2:]) if b.exact is not None else (b.last, True)
    return Part(None, first, last, both(_open(a).query, _open(b).query, seam, cut_first, cut_last))


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _exact(a.exact | b.exact)
    a, b = _open(a), _open(b)
    # strings that beginnings and ends alone spell out belong to the query, as one side's may be cut
    query = either(*[both(x.query, of_strings(x.first), of_strings(x.last)) for x in (a, b)])
    return Part(None, _few(a.first | b.first, lambda s: s[:2])[0], _few(a.last | b.last, lambda s: s[-2:])[0], query)


def _characters(items) -> Part:
    found = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(value)
        elif op is C.RANGE and value[1] - value[0] < 64:
            found.update(range(value[0], value[1] + 1))
        else:
            return ANY
    low = {chr(v).lower() for v in found}
    # beyond ASCII, the lower case of a character may hang on its neighbours
    return _exact(low) if len(low) <= CLASS and all(v < 128 for v in found) else ANY


def _repeat(least, most, part: Part) -> Part:
    if least == 0:
        return _or(NOTHING, part) if most == 1 and part.exact is not None else ANY
    done = part
    for _ in range(min(least, 3) - 1):
        done = _then(done, part)
    return done if least == most <= 3 else _open(done)


def _sequence(parsed) -> Part:
    done = NOTHING
    for op, value in parsed:
        if op is C.LITERAL:
            part = _characters([(op, value)])
        elif op is C.IN:
            part = _characters(value)
        elif op is C.BRANCH:
            part = _sequence(value[1][0])
            for other in value[1][1:]:
                part = _or(part, _sequence(other))
        elif op is C.SUBPATTERN:
            part = _sequence(value[3])
        elif op is C.ATOMIC_GROUP:
            part = _sequence(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            part = _repeat(value[0], value[1], _sequence(value[2]))
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = NOTHING
        else:
            part = ANY
        done = _then(done, part)
    return done


def trigram_query(pattern: str) -> object:
    """The query of a pattern; True if it requires no trigram, or is written in a way that only Java reads, or reads otherwise."""
    if re.search(r"\(\?-?[a-zA-Z]*[ux]|\\v", pattern):  # other letters in either case, comments, line ends
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested classes, which Java reads otherwise
            part = _sequence(_parser.parse(pattern))
    except (re.error, FutureWarning, DeprecationWarning):
        return True
    return both(_open(part).query, of_strings(part.first), of_strings(part.last))


def grams_of(query) -> set[str]:
    """All trigrams that a query asks for."""
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))
