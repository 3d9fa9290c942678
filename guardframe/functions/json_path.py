"""The four operators that step into JSON text: ->, ->>, #> and #>>, over VARIANT.

A step is a key or a place in an array, from 0 on or from the end if negative. What is not
there, text that is no JSON and a null text give null, as does a JSON null as text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The kinds of step: a key into an object, a place into an array, either by the value that is met.
Step = str | int


def _key(v: Column, key: str) -> Column:
    if key and not set(key) & set("'\"\\[]"):
        return F.try_variant_get(v, f"$['{key}']", "variant")
    # a path has no way to write such a key
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def _item(v: Column, place: int) -> Column:
    if place >= 0:
        return F.try_variant_get(v, f"$[{place}]", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "array<variant>"), F.lit(place))


def _into(j: Column | str, path: tuple[Step, ...], either: bool) -> Column:
    v = F.try_parse_json(j)
    for step in path:
        if isinstance(step, int):
            v = _item(v, step)
        elif either and step.lstrip("-").isdecimal():
            v = F.coalesce(_key(v, step), _item(v, int(step)))
        else:
            v = _key(v, step)
    return v


def _text(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string"))


def json_get(j: Column | str, step: Step) -> Column:
    """j -> step, as JSON text."""
    return F.to_json(_into(j, (step,), False))


def json_get_text(j: Column | str, step: Step) -> Column:
    """j ->> step: a string without its quotes, anything else as JSON text."""
    return _text(_into(j, (step,), False))


def json_path(j: Column | str, path: list[str]) -> Column:
    """j #> path, as JSON text; a step of digits is a key of an object or a place of an array."""
    return F.to_json(_into(j, tuple(path), True))


def json_path_text(j: Column | str, path: list[str]) -> Column:
    """j #>> path, as text."""
    return _text(_into(j, tuple(path), True))
