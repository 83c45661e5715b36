"""Boolean trigram queries that every match of a regular expression satisfies.

A query is ``None`` (nothing is required), a trigram, or ``("and" | "or", [queries])``.
Characters are folded to lower case, as in the index.
"""

from __future__ import annotations

from re import _parser as parser

#: Strings that one stretch of an expression may stand for before it is given up as unbounded.
MOST = 48


def _both(kind: str, parts: list):
    """Simplified conjunction or disjunction."""
    if kind == "or" and any(p is None for p in parts):
        return None
    flat = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q is not None and q not in flat:
                flat.append(q)
    if kind == "or":  # an alternative that asks for more than another adds nothing
        asks = [vocabulary(q) if isinstance(q, str) or q[0] == "and" and all(isinstance(x, str) for x in q[1]) else None for q in flat]
        flat = [q for q, a in zip(flat, asks, strict=True) if a is None or not any(b is not None and b < a for b in asks)]
    return None if not flat else flat[0] if len(flat) == 1 else (kind, flat)


def _of_strings(strings: set[str]):
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            out.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(items) -> tuple[set[str] | None, object]:
    """(the strings it stands for, or None if unbounded; the query of what is not in them)."""
    runs: list = []
    now: set[str] | None = {""}
    bounded = True

    def more(strings: set[str]) -> None:
        nonlocal now
        now = {a + b for a in now for b in strings}
        if len(now) > MOST:
            end()
            now = set(strings)

    def end() -> None:
        nonlocal now, bounded
        runs.append(_of_strings(now))
        now, bounded = {""}, False

    for op, value in items:
        kind = str(op)
        if kind == "LITERAL":
            more({chr(value).lower()})
        elif kind == "IN" and (found := _class(value)) is not None:
            more(found)
        elif kind in ("SUBPATTERN", "BRANCH"):
            inner = [value[-1]] if kind == "SUBPATTERN" else value[1]
            found = [_walk(x) for x in inner]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST:
                more(set().union(*(s for s, _ in found)))
            else:
                end()
                runs.append(_both("or", [_of_strings(s) if s is not None else q for s, q in found]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            strings, rest = _walk(inner)
            if strings is not None and low == 0 and high == 1:
                more({""} | strings)
            elif strings is not None and low == high and low <= 8:
                for _ in range(low):
                    more(strings)
            elif low == 0:
                end()
            else:
                for _ in range(min(low, 3)) if strings is not None else ():
                    more(strings)
                end()
                runs.append(rest)
                if strings is not None:
                    now = set(strings)  # what follows comes after one more copy
        elif kind == "AT":
            pass
        else:
            end()
    if bounded:
        return now, None
    runs.append(_of_strings(now))
    return None, _both("and", runs)


def trigram_query(regex: str):
    strings, query = _walk(parser.parse(regex))
    return _of_strings(strings) if strings is not None else query


def vocabulary(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(vocabulary(q) for q in query[1]))
