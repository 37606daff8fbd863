"""Boolean trigram queries from regular expressions.

A text that matches an expression must hold certain runs of three characters. The query that says so is derived from
the parsed expression, in lower case, as alternatives each of which is a set of trigrams that must all be there.
"""

from __future__ import annotations

import re

#: Strings followed side by side before they are turned into trigrams, and alternatives that a query keeps at most. A
#: query that would have more is widened, never narrowed: the verification decides.
MOST = 16
#: Characters of a class that is read as alternatives.
FEW = 8

_parse = re._parser.parse  # the standard library's own parser of expressions
_names = re._constants

Clauses = frozenset[frozenset[str]]  # any of these, all of each
ANY: Clauses = frozenset([frozenset()])


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(clauses) -> Clauses:
    """Drop alternatives that another one contains."""
    kept = [c for c in clauses if not any(o < c for o in clauses)]
    return frozenset(kept) if len(kept) <= MOST else ANY


def _all(a: Clauses, b: Clauses) -> Clauses:
    both = _least(frozenset(x | y for x in a for y in b))
    return both if both != ANY else (a if a != ANY else b)


def _of(strings: frozenset[str]) -> Clauses:
    return _least(frozenset(grams(s) for s in strings))


def _characters(item) -> frozenset[str] | None:
    """The lower-case characters of a small class, or None."""
    out = set()
    for op, arg in item:
        if op is _names.LITERAL:
            out.add(chr(arg).lower())
        elif op is _names.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= FEW else None


def _walk(items) -> tuple[frozenset[str] | None, Clauses]:
    """The strings that the items match, if they are few, and what else must be there."""
    run, need, exact = frozenset([""]), ANY, True

    def close(keep: bool) -> None:
        nonlocal run, need, exact
        need, exact = _all(need, _of(run)), False
        run = frozenset(s[-2:] for s in run) if keep else frozenset([""])

    def follow(strings: frozenset[str]) -> None:
        nonlocal run
        if len(run) * len(strings) > MOST:
            close(keep=True)
        if len(run) * len(strings) > MOST:
            close(keep=False)
        else:
            run = frozenset(a + b for a in run for b in strings)

    for op, arg in items:
        if op is _names.LITERAL:
            follow(frozenset([chr(arg).lower()]))
        elif op is _names.IN and (few := _characters(arg)):
            follow(few)
        elif op is _names.SUBPATTERN or op is _names.ATOMIC_GROUP:
            strings, more = _walk(arg[-1] if op is _names.SUBPATTERN else arg)
            if strings is not None:
                follow(strings)
            else:
                close(keep=False)
                need = _all(need, more)
        elif op is _names.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                follow(frozenset().union(*(s for s, _ in parts)))
            else:
                close(keep=False)
                need = _all(need, _least(frozenset().union(*(_of(s) if s is not None else m for s, m in parts))))
        elif op in (_names.MAX_REPEAT, _names.MIN_REPEAT, _names.POSSESSIVE_REPEAT):
            least, most, what = arg
            strings, more = _walk(what)
            if strings is not None and most == 1:
                follow(strings | {""} if least == 0 else strings)
            elif strings is not None and least == most and least <= 8:
                for _ in range(least):
                    follow(strings)
            else:
                close(keep=False)
                if least:
                    need = _all(need, _of(strings) if strings is not None else more)
        elif op in (_names.AT, _names.ASSERT, _names.ASSERT_NOT):
            pass  # takes no characters; leaving it out only widens the query
        else:
            close(keep=False)
    if exact:
        return run, ANY
    return None, _all(need, _of(run))


def query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of pattern's trigram query; empty where a text can match without any given trigram."""
    strings, need = _walk(_parse(pattern))
    clauses = _of(strings) if strings is not None else need
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)
