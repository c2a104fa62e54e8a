"""Syntax structures whose elements depend on earlier values: one grammar for writing, reading and drawing values.

A grammar lists items and repeated groups in coded order. Widths, conditions and counts are functions of a Scope: the values of the
structure so far, then those of the structures around it, then those of other structures that it refers to.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

UE = "ue"
Values = dict[str, Any]


class Scope(ChainMap):
    """Values by name, the innermost structure's first; what is nowhere is zero."""

    def __missing__(self, name: str) -> int:
        return 0


def _always(s: Scope) -> bool:
    return True


@dataclass(frozen=True)
class Item:
    """One element; code: bits, UE (exp-Golomb), a function that gives the bits, or None for syntax that is not supported."""

    name: str
    code: int | str | Callable[[Scope], int] | None
    default: int = 0  # written where no value is given
    absent: int | Callable[[Scope], int] = 0  # its value where it is not coded
    when: Callable[[Scope], Any] = _always


@dataclass(frozen=True)
class Many:
    """A group that is coded several times; its value is a list of the group's values."""

    name: str
    times: Callable[[Scope], int]
    items: tuple[Item | Many, ...]
    when: Callable[[Scope], Any] = _always


Grammar = Iterable[Item | Many]


def only(when: Callable[[Scope], Any], *items: Item | Many) -> list[Item | Many]:
    """Items that are coded only then, whatever else they ask."""
    return [replace(x, when=lambda s, own=x.when: when(s) and own(s)) for x in items]


def flag(name: str) -> Callable[[Scope], Any]:
    return lambda s: s[name]


def ceil_log2(n: int) -> int:
    return max(0, n - 1).bit_length()


def walk(grammar: Grammar, exchange: Callable[[Item, int | str, int], int], given: Values | None = None, *around: Values) -> Values:
    """All values of a structure, those inferred too; exchange(item, code, value given) codes one element and tells its value.

    Values given for what is not coded there, and names that the grammar doesn't have, are errors: nothing is lost in silence.
    """
    return _walk(list(grammar), exchange, given or {}, Scope({}, *around))


def _walk(grammar: Grammar, exchange: Callable[[Item, int | str, int], int], given: Values, scope: Scope) -> Values:
    own, names = scope.maps[0], {x.name for x in grammar}
    if unknown := given.keys() - names:
        raise ValueError(f"no such elements: {', '.join(sorted(unknown))}")
    for x in grammar:
        coded = x.when(scope)
        if isinstance(x, Many):
            rows, wanted = [], given.get(x.name, [])
            own[x.name] = rows
            times = x.times(scope) if coded else 0
            if len(wanted) > times:
                raise ValueError(f"{x.name}: {len(wanted)} given, {times} coded")
            for i in range(times):
                rows.append({})
                _walk(x.items, exchange, wanted[i] if i < len(wanted) else {}, scope.new_child(rows[-1]))
            continue
        if not coded:
            own[x.name] = x.absent(scope) if callable(x.absent) else x.absent
            if int(given.get(x.name, own[x.name])) != own[x.name]:
                raise ValueError(f"{x.name} is {given[x.name]}, but is not coded here and means {own[x.name]}")
            continue
        if x.code is None:
            raise NotImplementedError(f"{x.name} has no syntax here")
        own[x.name] = exchange(x, x.code(scope) if callable(x.code) else x.code, int(given.get(x.name, x.default)))
    return own
