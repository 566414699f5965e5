"""Flat option maps, immutable: every change gives a new map. ``/`` separates subtrees."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Options = Mapping[str, str]


def get(options: Options, key: str, default: str | None = None, allowed: tuple[str, ...] = ()) -> str | None:
    found = options.get(key, default)
    if allowed and found is not None and found not in allowed:
        raise ValueError(f"{key} is {found!r}, not one of {', '.join(allowed)}")
    return found


def is_true(options: Options, key: str) -> bool:
    return (options.get(key) or "").lower() == "true"


def is_false(options: Options, key: str) -> bool:
    return (options.get(key) or "").lower() == "false"


def merged(first: Options, second: Options) -> dict[str, str]:
    """Both; ``first`` wins."""
    return {**second, **first}


def with_(options: Options, key: str, value: object) -> dict[str, str]:
    """The key set; None deletes it."""
    return without(options, key) if value is None else {**options, key: str(value)}


def without(options: Options, key: str) -> dict[str, str]:
    return {k: v for k, v in options.items() if k != key}


def subtree(options: Options, name: str) -> dict[str, str]:
    return {k[len(name) + 1 :]: v for k, v in options.items() if k.startswith(name + "/")}


def as_subtree(options: Options, name: str) -> dict[str, str]:
    return {f"{name}/{k}": v for k, v in options.items()}


def parse_arguments(args: list[str], known: set[str]) -> dict[str, str]:
    """``--key value`` pairs; an unknown key or a missing value raises."""
    if len(args) % 2:
        raise ValueError("a key has no value")
    out = {}
    for key, value in zip(args[::2], args[1::2], strict=True):
        name = key.removeprefix("--")
        if name not in known:
            raise KeyError(f"unknown key: {key}")
        out[name] = value
    return out


def merge_maps(first: Column, second: Column) -> Column:
    """Map columns: both, ``first`` wins."""
    return F.map_from_entries(F.concat(F.map_entries(first), F.filter(F.map_entries(second), lambda e: ~F.map_contains_key(first, e["key"]))))


def subtree_map(options: Column, name: str) -> Column:
    own = F.map_filter(options, lambda k, v: F.startswith(k, F.lit(name + "/")))
    return F.transform_keys(own, lambda k, v: F.substring(k, len(name) + 2, 1_000_000))


def upsert_map(options: Column, key: str, value: Column) -> Column:
    """The key set where ``value`` is not null, deleted where it is."""
    rest = F.map_filter(options, lambda k, v: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))
