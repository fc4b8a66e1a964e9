"""Edits of JSON text, as vectorised functions: Spark has no expression that writes into a JSON document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _load(text):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except json.JSONDecodeError:
        return None


def _merge(base, patch):
    """A merge patch: null removes, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _at(tree, path: str) -> tuple[dict | None, str]:
    *way, last = path.removeprefix("$").strip(".").split(".")
    for k in way:
        if not isinstance(tree, dict):
            return None, last
        tree = tree.setdefault(k, {})
    return (tree if isinstance(tree, dict) else None), last


@F.pandas_udf(T.StringType())
def _set(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    def one(d, p, v):
        tree = _load(d)
        if tree is None or p is None:
            return None
        place, last = _at(tree, p)
        if place is not None:
            given = _load(v)
            place[last] = v if given is None and v != "null" else given
        return json.dumps(tree, ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(doc, path, value)])


@F.pandas_udf(T.StringType())
def _remove(doc: pd.Series, path: pd.Series) -> pd.Series:
    def one(d, p):
        tree = _load(d)
        if tree is None or p is None:
            return None
        place, last = _at(tree, p)
        if place is not None:
            place.pop(last, None)
        return json.dumps(tree, ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(doc, path)])


@F.pandas_udf(T.StringType())
def _patch(doc: pd.Series, patch: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or p is None else json.dumps(_merge(_load(d), _load(p)), ensure_ascii=False) for d, p in zip(doc, patch)])


FUNCTIONS = {
    "json_set": lambda d, p, v: _set(d, p, v.cast("string")),
    "json_remove": lambda d, p: _remove(d, p),
    "json_patch": lambda d, p: _patch(d, p),
}
