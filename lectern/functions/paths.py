"""Writes at nested places of JSON texts, without a schema.

A path is taken apart once, on the driver; the rewriting is one expression over
variants: an object is a map of variants, a list an array of variants, and only
what lies on the path is rebuilt.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'\.(?P<key>[^.\["]+)|\."(?P<quoted>[^"]*)"|\[(?P<place>\d+)\]|\[#(?:-(?P<back>[1-9]\d*))?\]')
OBJECT, LIST = "map<string,variant>", "array<variant>"


@dataclass(frozen=True)
class Key:
    """A field of an object."""

    name: str


@dataclass(frozen=True)
class Place:
    """A place of a list from 0; ``from_end`` counts back from behind the last (0: append)."""

    at: int
    from_end: bool = False

    def index(self, length: Column) -> Column:
        return length - self.at if self.from_end else F.lit(self.at)


def parse_path(path: str) -> list[Key | Place]:
    """The steps of ``$.key."any key"[3][#][#-1]``; anything else is an error."""
    steps, at = [], 1
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path}")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"no path step at {path[at:]!r} in {path}")
        if m["key"] is not None or m["quoted"] is not None:
            steps.append(Key(m["key"] if m["key"] is not None else m["quoted"]))
        elif m["place"] is not None:
            steps.append(Place(int(m["place"])))
        else:
            steps.append(Place(int(m["back"] or 0), from_end=True))
        at = m.end()
    return steps


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is named once: writes that follow each other would otherwise repeat it manifold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fresh(steps: list[Key | Place], value: Column) -> Column | None:
    """What stands where nothing stood: objects and lists of one around the value; None if a list would have a hole."""
    for step in reversed(steps):
        if isinstance(step, Key):
            value = F.to_variant_object(F.create_map(F.lit(step.name), value))
        elif step.at == 0:
            value = F.to_variant_object(F.array(value))
        else:
            return None
    return value


def put(node: Column, steps: list[Key | Place], value: Column) -> Column:
    """A variant with ``value`` at the place of the steps; unchanged where the path runs into something else."""
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    fresh = _fresh(rest, value)
    if isinstance(step, Key):
        fields = node.try_cast(OBJECT)
        child = F.try_element_at(fields, F.lit(step.name))
        others = F.map_filter(fields, lambda k, _: k != step.name)
        set_to = lambda new: F.to_variant_object(F.map_concat(others, F.create_map(F.lit(step.name), new)))
        out = F.when(child.isNotNull(), set_to(put(child, rest, value)))
        return (out if fresh is None else out.when(fields.isNotNull(), set_to(fresh))).otherwise(node)
    items = node.try_cast(LIST)
    at = step.index(F.size(items))
    changed = F.transform(items, lambda x, i: F.when(i == at, put(x, rest, value)).otherwise(x))
    out = F.when((at >= 0) & (at < F.size(items)), F.to_variant_object(changed))
    return (out if fresh is None else out.when(at == F.size(items), F.to_variant_object(F.concat(items, F.array(fresh))))).otherwise(node)


def _writer(steps: list[Key | Place], value: Column) -> Callable[[Column], Column]:
    return lambda node: F.when(node.isNotNull(), put(node, steps, value))


def json_write(text: Column, writes: dict[str, Column]) -> Column:
    """The JSON text with values at paths, one write after the other.

    Values are plain columns, arrays or variants; null is written as a JSON null. A key
    that is missing is added, with the objects above it; a place just behind a list appends
    to it, one farther on changes nothing, nor does a path through a value of another kind
    (a JSON null included). Null and broken texts give null. Keys come out in the order of their names.
    """
    node = F.try_parse_json(text)
    for path, value in writes.items():
        steps, given = parse_path(path), F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))
        node = _bound(node, _writer(steps, given))
    return F.to_json(node)
