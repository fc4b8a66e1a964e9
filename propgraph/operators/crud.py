"""Edits of a graph. Each gives a new graph; the old one stays as it was (copy on write)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import NODE_KEYS, REL_KEYS, PropertyGraph, col, common_type, stacked


class GraphError(ValueError):
    """An edit that the graph does not allow."""


def _kind(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    return T.StringType()


def _plain(value):
    """What a property can hold: numbers, truth values and text; lists and maps as JSON text."""
    return json.dumps(value) if isinstance(value, (list, dict)) else value


def _row(graph: PropertyGraph, keys: dict[str, int], props: dict) -> DataFrame:
    props = {k: _plain(v) for k, v in props.items() if v is not None}
    fields = [T.StructField(k, T.LongType()) for k in keys] + [T.StructField(k, _kind(v)) for k, v in props.items()]
    return graph.spark.createDataFrame([(*keys.values(), *props.values())], T.StructType(fields))


def _props(props: dict | str | None) -> dict:
    if isinstance(props, str):
        try:
            props = json.loads(props or "{}")
        except json.JSONDecodeError as error:
            raise GraphError(f"properties are no JSON: {error}") from error
    if not isinstance(props or {}, dict):
        raise GraphError("properties are no JSON object")
    return props or {}


def _labels(labels: str | Iterable[str]) -> frozenset[str]:
    return frozenset(labels.split() if isinstance(labels, str) else labels)


def next_id(graph: PropertyGraph, of: str) -> int:
    view = graph.node_view((), ()) if of == "node" else graph.rel_view((), ())
    return int(view.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1


def create_node(graph: PropertyGraph, labels: str | Iterable[str] = "", props: dict | str | None = None) -> tuple[PropertyGraph, int]:
    new = next_id(graph, "node")
    return graph.with_nodes(_labels(labels), _row(graph, {"id": new}, _props(props))), new


def get_node(graph: PropertyGraph, node_id: int) -> dict | None:
    r = graph.node_view().filter(F.col("id") == node_id).first()
    if r is None:
        return None
    d = r.asDict()
    return {"id": d.pop("id"), "labels": d.pop("labels"), "properties": {k: v for k, v in d.items() if v is not None}}


def get_rel(graph: PropertyGraph, rel_id: int) -> dict | None:
    r = graph.rel_view().filter(F.col("id") == rel_id).first()
    if r is None:
        return None
    d = r.asDict()
    return {k: d.pop(k) for k in ("id", "src", "dst", "type")} | {"properties": {k: v for k, v in d.items() if v is not None}}


def set_values(df: DataFrame, keys: tuple[str, ...], key: str, value: Column, kind: T.DataType, where: Column) -> DataFrame:
    """``df`` with a property set where a condition holds; its type widens if it must."""
    if key in keys:
        raise GraphError(f"{key} cannot be set")
    own = {f.name: f.dataType for f in df.schema}
    t = common_type([own.get(key, T.NullType()), kind])
    before = col(key).cast(t) if key in own else F.lit(None).cast(t)
    return df.withColumn(key, F.when(where, value.cast(t)).otherwise(before))


def _set(graph: PropertyGraph, of: str, entity: int, key: str, value, raw: bool) -> PropertyGraph:
    if raw:
        try:
            value = json.loads(value)
        except (json.JSONDecodeError, TypeError) as error:
            raise GraphError(f"value is no JSON: {error}") from error
    tables = graph.nodes if of == "node" else graph.rels
    keys = NODE_KEYS if of == "node" else REL_KEYS
    where = F.col("id") == entity
    name, found = next(((n, df) for n, df in tables.items() if df.filter(where).limit(1).count()), (None, None))
    if found is None:
        raise GraphError(f"no {of} {entity}")
    head, *rest = key.split(".")
    if rest:  # a nested place, kept as JSON text
        old = found.filter(where).select(col(head).cast("string") if head in found.columns else F.lit(None).cast("string")).first()[0]
        tree = json.loads(old) if old else {}
        at = tree
        for k in rest[:-1]:
            at = at.setdefault(k, {})
        at[rest[-1]] = value
        value = tree
    value = _plain(value)
    new = set_values(found, keys, head, F.lit(value), _kind(value) if value is not None else T.NullType(), where)
    return graph.replaced(**{"nodes" if of == "node" else "rels": tables | {name: new}})


def set_node_property(graph: PropertyGraph, node_id: int, key: str, value_json: str) -> PropertyGraph:
    return _set(graph, "node", node_id, key, value_json, True)


def set_rel_property(graph: PropertyGraph, rel_id: int, key: str, value_json: str) -> PropertyGraph:
    return _set(graph, "rel", rel_id, key, value_json, True)


def remove_node_property(graph: PropertyGraph, node_id: int, key: str) -> PropertyGraph:
    return _set(graph, "node", node_id, key, None, False)


def remove_rel_property(graph: PropertyGraph, rel_id: int, key: str) -> PropertyGraph:
    return _set(graph, "rel", rel_id, key, None, False)


def relabel(graph: PropertyGraph, ids: DataFrame, add: Iterable[str] = (), remove: Iterable[str] = ()) -> PropertyGraph:
    """Nodes of ``ids`` (column ``id``) move to the table of their new label set."""
    nodes: dict[frozenset[str], DataFrame] = {}
    for own, df in graph.nodes.items():
        target = (own | frozenset(add)) - frozenset(remove)
        if target == own:
            nodes[own] = stacked(nodes.get(own), df, NODE_KEYS)
            continue
        nodes[own] = stacked(nodes.get(own), df.join(ids, "id", "left_anti"), NODE_KEYS)
        nodes[target] = stacked(nodes.get(target), df.join(ids, "id", "left_semi"), NODE_KEYS)
    ends = {t: (frozenset(), frozenset()) for t in graph.ends} if remove else graph.ends
    return graph.replaced(nodes=nodes, ends=ends)


def _one(graph: PropertyGraph, node_id: int) -> DataFrame:
    if not graph.node_view((), ()).filter(F.col("id") == node_id).limit(1).count():
        raise GraphError(f"no node {node_id}")
    return graph.spark.createDataFrame([(node_id,)], "id long")


def add_label(graph: PropertyGraph, node_id: int, label: str) -> PropertyGraph:
    return relabel(graph, _one(graph, node_id), add=[label])


def remove_label(graph: PropertyGraph, node_id: int, label: str) -> PropertyGraph:
    return relabel(graph, _one(graph, node_id), remove=[label])


def delete_nodes(graph: PropertyGraph, ids: DataFrame, detach: bool) -> PropertyGraph:
    """Without ``detach`` no relationship may be left on them."""
    src, dst = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    if not detach:
        view = graph.rel_view((), ())
        if view.join(src, "src", "left_semi").limit(1).count() or view.join(dst, "dst", "left_semi").limit(1).count():
            raise GraphError("nodes still have relationships; delete them first or detach")
    rels = {t: df.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*df.columns) for t, df in graph.rels.items()} if detach else graph.rels
    return graph.replaced(nodes={k: df.join(ids, "id", "left_anti") for k, df in graph.nodes.items()}, rels=rels)


def delete_rels(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return graph.replaced(rels={t: df.join(ids, "id", "left_anti") for t, df in graph.rels.items()})


def delete_node(graph: PropertyGraph, node_id: int, detach: bool = False) -> PropertyGraph:
    return delete_nodes(graph, _one(graph, node_id), detach)


def delete_rel(graph: PropertyGraph, rel_id: int) -> PropertyGraph:
    if get_rel(graph, rel_id) is None:
        raise GraphError(f"no relationship {rel_id}")
    return delete_rels(graph, graph.spark.createDataFrame([(rel_id,)], "id long"))


def create_rel(graph: PropertyGraph, src: int, dst: int, type_: str, props: dict | str | None = None) -> tuple[PropertyGraph, int]:
    _one(graph, src)
    _one(graph, dst)
    new = next_id(graph, "rel")
    return graph.with_rels(type_, _row(graph, {"id": new, "src": src, "dst": dst}, _props(props))), new


def clear(graph: PropertyGraph) -> PropertyGraph:
    return graph.replaced(nodes={}, rels={}, ends={})


def matching(graph: PropertyGraph, labels: Iterable[str], props: dict) -> DataFrame:
    """``id`` of nodes that have the labels and hold the values."""
    known = graph.node_props(labels)
    rows = graph.node_view(labels, [k for k in props if k in known])
    for k, v in props.items():
        rows = rows.filter(F.lit(False) if k not in known else col(k) == F.lit(_plain(v)))
    return rows.select("id")


def merge_node(graph: PropertyGraph, labels: str | Iterable[str], match: dict | str, on_create: dict | str | None = None, on_match: dict | str | None = None) -> tuple[PropertyGraph, int]:
    """The least node that matches, with ``on_match`` merged in (null removes); else a new one with both ``match`` and ``on_create``."""
    match, on_create, on_match = _props(match), _props(on_create), _props(on_match)
    found = matching(graph, _labels(labels), match).agg(F.min("id")).first()[0]
    if found is None:
        return create_node(graph, labels, match | on_create)
    for k, v in on_match.items():
        graph = _set(graph, "node", found, k, v, False)
    return graph, found
