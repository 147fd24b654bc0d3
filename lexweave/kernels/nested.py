"""Interval labelling of nested records, free of Spark."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

DEFAULT_KIND = "Paragraph"


class Node(NamedTuple):
    """One element; a node lies below another if its pre and post lie within the other's."""

    pre: int
    post: int
    place: int
    kind: str
    identifier: str
    title: str | None
    text: str | None
    intro: str | None
    wrap_up: str | None


class Unreadable(ValueError):
    """A level that is no valid JSON."""


def _refuse(token: str) -> None:
    raise Unreadable(token)


def _siblings(level: Any) -> list[dict]:
    """The objects of one level, which may be an array, a single object, or either of them written as a string."""
    found: list[dict] = []
    todo = [level]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if item.strip():
                try:
                    todo.append(json.loads(item, parse_constant=_refuse))
                except (ValueError, RecursionError) as e:
                    raise Unreadable(str(e)) from e
        elif isinstance(item, dict):
            found.append(item)
        elif isinstance(item, list):
            todo.extend(reversed(item))
    return found


def _string(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def label(children: str | None) -> list[Node]:
    """Pre- and post-order numbers of every element of a record, in pre-order; no recursion, so depth has no limit.

    A record of which any level can't be read has no elements.
    """
    if children is None:
        return []
    try:
        top = _siblings(children)
    except Unreadable:
        return []
    nodes: list[list] = []
    clock = 0
    stack: list[tuple[int, int, dict | None]] = [(i + 1, -1, o) for i, o in reversed(list(enumerate(top)))]
    try:
        while stack:
            place, at, obj = stack.pop()
            clock += 1
            if obj is None:
                nodes[at][1] = clock
                continue
            at = len(nodes)
            nodes.append([clock, 0, place, _string(obj.get("__type__")) or DEFAULT_KIND, _string(obj.get("identifier")) or "", *(_string(obj.get(k)) for k in ("title", "text", "intro", "wrap_up"))])
            stack.append((0, at, None))
            stack.extend((i + 1, -1, o) for i, o in reversed(list(enumerate(_siblings(obj.get("children"))))))
    except Unreadable:
        return []
    return [Node(*n) for n in nodes]


def link(nodes: list[Node]) -> list[tuple[str, str, int, int | None]]:
    """(node_path, parent_path, depth, parent's pre) of each labelled node, from interval containment alone.

    The parent is the innermost open interval that holds the node's; one sweep in pre-order finds it.
    """
    out: list[tuple[str, str, int, int | None]] = []
    around: list[tuple[int, int, str]] = []
    for n in nodes:
        while around and around[-1][1] < n.pre:
            around.pop()
        parent = around[-1] if around else None
        above = parent[2] if parent else "r"
        path = f"{above}.{n.place}"
        out.append((path, above, len(around) + 1, parent[0] if parent else None))
        around.append((n.pre, n.post, path))
    return out
