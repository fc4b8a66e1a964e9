"""The property graph: typed DataFrames of nodes by label set and of relationships by type.

Nodes of one set of labels are a table ``id`` plus properties; relationships of one type are a table
``id, src, dst`` plus properties. Ids are longs; relationship ids are unique over all types. Tables
are never changed: an edit puts new DataFrames in a new graph object's place (copy on write), and
``save`` writes a snapshot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KEYS = ("id",)
REL_KEYS = ("id", "src", "dst")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def common_type(types: Iterable[T.DataType]) -> T.DataType:
    """The type that a property takes where tables differ: number or text."""
    kinds = [t for t in dict.fromkeys(types) if not isinstance(t, T.NullType)]
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return kinds[0]
    if all(isinstance(t, T.IntegralType) for t in kinds):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in kinds):
        return T.DoubleType()
    return T.StringType()


def props_of(df: DataFrame, keys: tuple[str, ...]) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema if f.name not in keys}


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: dict[frozenset[str], DataFrame] = field(default_factory=dict)
    rels: dict[str, DataFrame] = field(default_factory=dict)
    #: For a type, labels that all its sources and all its targets have; lets plans leave out joins.
    ends: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)
    version: int = 1

    # views
    def node_tables(self, labels: Iterable[str] = ()) -> dict[frozenset[str], DataFrame]:
        wanted = set(labels)
        return {own: df for own, df in self.nodes.items() if wanted <= own}

    def labels(self) -> list[str]:
        return sorted({x for own in self.nodes for x in own})

    def types(self) -> list[str]:
        return sorted(self.rels)

    def node_props(self, labels: Iterable[str] = ()) -> dict[str, T.DataType]:
        return _merged(props_of(df, NODE_KEYS) for df in self.node_tables(labels).values())

    def rel_props(self, types: Iterable[str] = ()) -> dict[str, T.DataType]:
        return _merged(props_of(self.rels[t], REL_KEYS) for t in types or self.rels if t in self.rels)

    def node_view(self, labels: Iterable[str] = (), props: Iterable[str] | None = None) -> DataFrame:
        """``id, labels`` and properties of the nodes that have all ``labels``; absent properties are null."""
        known = self.node_props(labels)
        wanted = sorted(known if props is None else props)
        parts = [
            df.select("id", F.array(*[F.lit(x) for x in sorted(own)]).cast("array<string>").alias("labels"), *_pick(df, wanted, known))
            for own, df in self.node_tables(labels).items()
        ]
        return _union(self.spark, parts, [("id", T.LongType()), ("labels", T.ArrayType(T.StringType()))], wanted, known)

    def rel_view(self, types: Iterable[str] = (), props: Iterable[str] | None = None) -> DataFrame:
        """``id, src, dst, type`` and properties of the relationships of ``types`` (none: of all)."""
        types = list(types) or self.types()
        known = self.rel_props(types)
        wanted = sorted(known if props is None else props)
        parts = [self.rels[t].select("id", "src", "dst", F.lit(t).alias("type"), *_pick(self.rels[t], wanted, known)) for t in types if t in self.rels]
        return _union(self.spark, parts, [("id", T.LongType()), ("src", T.LongType()), ("dst", T.LongType()), ("type", T.StringType())], wanted, known)

    # making
    def with_nodes(self, labels: Iterable[str], df: DataFrame) -> PropertyGraph:
        """This graph with more nodes of that label set."""
        key = frozenset(labels)
        return self.replaced(nodes=self.nodes | {key: stacked(self.nodes.get(key), df, NODE_KEYS)})

    def with_rels(self, type_: str, df: DataFrame, src: Iterable[str] = (), dst: Iterable[str] = ()) -> PropertyGraph:
        ends = dict(self.ends)
        mine = (frozenset(src), frozenset(dst))
        ends[type_] = (ends[type_][0] & mine[0], ends[type_][1] & mine[1]) if type_ in self.rels and type_ in ends else mine if type_ not in self.rels else (frozenset(), frozenset())
        return self.replaced(rels=self.rels | {type_: stacked(self.rels.get(type_), df, REL_KEYS)}, ends=ends)

    def replaced(self, **changes) -> PropertyGraph:
        own = {"spark": self.spark, "nodes": self.nodes, "rels": self.rels, "ends": self.ends, "version": self.version + 1}
        return PropertyGraph(**(own | changes))

    # use as a context manager mirrors opening and closing a store
    def __enter__(self) -> PropertyGraph:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Give back what was cached."""
        for df in [*self.nodes.values(), *self.rels.values()]:
            df.unpersist()

    def query(self, text: str, params: dict | None = None, semantics: str = "standard") -> DataFrame:
        """Rows of a reading query."""
        from .plans.compiler import read_query

        return read_query(self, text, params, semantics)

    def execute(self, text: str, params: dict | None = None) -> tuple[PropertyGraph, DataFrame]:
        """The graph after a writing query, and the query's rows."""
        from .plans.writer import execute

        return execute(self, text, params)

    # snapshots
    def save(self, path: str) -> None:
        """Write a snapshot: a Parquet table for each label set and type, and a manifest."""
        entries = []
        for i, (labels, df) in enumerate(sorted(self.nodes.items(), key=lambda x: sorted(x[0]))):
            df.write.mode("overwrite").parquet(f"{path}/v{self.version}/nodes/{i}")
            entries.append(("node", json.dumps(sorted(labels)), f"v{self.version}/nodes/{i}", "[]"))
        for i, (type_, df) in enumerate(sorted(self.rels.items())):
            df.write.mode("overwrite").parquet(f"{path}/v{self.version}/rels/{i}")
            ends = self.ends.get(type_, (frozenset(), frozenset()))
            entries.append(("rel", json.dumps(type_), f"v{self.version}/rels/{i}", json.dumps([sorted(ends[0]), sorted(ends[1])])))
        rows = [(self.version, *e) for e in entries] or [(self.version, "empty", "[]", "", "[]")]
        self.spark.createDataFrame(rows, "version long, kind string, name string, place string, ends string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
        manifest = spark.read.parquet(f"{path}/manifest")
        version = version or manifest.agg(F.max("version")).first()[0]
        nodes, rels, ends = {}, {}, {}
        for r in manifest.filter(F.col("version") == version).collect():
            if r["kind"] == "node":
                nodes[frozenset(json.loads(r["name"]))] = spark.read.parquet(f"{path}/{r['place']}")
            elif r["kind"] == "rel":
                rels[json.loads(r["name"])] = spark.read.parquet(f"{path}/{r['place']}")
                ends[json.loads(r["name"])] = tuple(frozenset(x) for x in json.loads(r["ends"]))
        return PropertyGraph(spark, nodes, rels, ends, version)

    @staticmethod
    def from_json_tables(spark: SparkSession, nodes: DataFrame, rels: DataFrame) -> PropertyGraph:
        """A graph from ``id, labels, properties`` and ``id, src_id, dst_id, type, properties``: labels separated by spaces, properties as JSON text.

        One pass a label set or type infers the properties' types.
        """
        sets = [r[0] for r in nodes.select(F.coalesce("labels", F.lit(""))).distinct().collect()]
        graph = PropertyGraph(spark)
        for own in sorted(sets):
            rows = nodes.filter(F.coalesce("labels", F.lit("")) == own).select("id", "properties")
            graph = graph.with_nodes(own.split(), _parsed(spark, rows, NODE_KEYS))
        for t in sorted(r[0] for r in rels.select("type").distinct().collect()):
            rows = rels.filter(F.col("type") == t).select("id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "properties")
            graph = graph.with_rels(t, _parsed(spark, rows, REL_KEYS))
        return graph


def _parsed(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    texts = rows.filter("properties IS NOT NULL").select(F.col("properties").alias("value"))
    found = texts.agg(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0] if rows.take(1) else None
    inner = found.replace("OBJECT", "STRUCT", 1) if found and found.startswith("OBJECT<") and found != "OBJECT<>" else None
    base = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "properties")
    if not inner:
        return base.drop("properties")
    inner = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", inner.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING"))
    return base.withColumn("p", F.from_json("properties", inner)).select(*keys, "p.*")


def _merged(schemas: Iterable[dict[str, T.DataType]]) -> dict[str, T.DataType]:
    found: dict[str, list[T.DataType]] = {}
    for s in schemas:
        for k, t in s.items():
            found.setdefault(k, []).append(t)
    return {k: common_type(ts) for k, ts in found.items()}


def _pick(df: DataFrame, wanted: list[str], known: dict[str, T.DataType]) -> list[Column]:
    own = dict(zip(df.columns, df.schema))
    out = []
    for k in wanted:
        t = known.get(k, T.StringType())
        c = col(k) if k in own else F.lit(None)
        out.append((c if k in own and own[k].dataType == t else c.cast(t)).alias(k))
    return out


def _union(spark: SparkSession, parts: list[DataFrame], keys: list[tuple[str, T.DataType]], wanted: list[str], known: dict[str, T.DataType]) -> DataFrame:
    if not parts:
        fields = [T.StructField(k, t) for k, t in keys] + [T.StructField(k, known.get(k, T.StringType())) for k in wanted]
        return spark.createDataFrame([], T.StructType(fields))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stacked(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both, columns of both, each property in a type that holds either's values."""
    if old is None:
        return new
    known = _merged([props_of(old, keys), props_of(new, keys)])
    wanted = list(known)
    return old.select(*keys, *_pick(old, wanted, known)).unionByName(new.select(*keys, *_pick(new, wanted, known)))
