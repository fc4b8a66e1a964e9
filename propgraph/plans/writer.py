"""Writing queries: CREATE, MERGE, SET, REMOVE and DELETE over the rows that reading clauses find.

A write turns the rows so far into tables of new or changed elements and gives a new graph. Rows are
written to the checkpoint folder first, so that ids stay the same however often they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import NODE_KEYS, REL_KEYS, PropertyGraph, col
from ..operators import crud
from ..operators.common import cut
from . import ast as A
from .compiler import Binding, Compiler, Rows
from .lexer import CypherError
from .parser import parse


def is_read_only(text: str) -> bool:
    """Whether no clause of the query writes."""
    return not any(isinstance(c, A.WRITES) for part in parse(text).parts for c in part.clauses)


def execute(graph: PropertyGraph, text: str, params: dict | None = None) -> tuple[PropertyGraph, DataFrame]:
    union = parse(text)
    if is_read_only(text):
        return graph, Compiler(graph, params).statement(union)
    if len(union.parts) > 1:
        raise CypherError("UNION may not write")
    return _Writer(graph, params or {}).run(union.parts[0])


class _Writer:
    def __init__(self, graph: PropertyGraph, params: dict):
        self.graph, self.params = graph, params
        self.counts: dict[str, int] = {}

    def compiler(self, query: A.Query) -> Compiler:
        c = Compiler(self.graph, self.params)
        c.look(query)
        for clause in query.clauses:  # what a write touches must be at hand by id only
            for x in A.walk(clause):
                if isinstance(x, (A.SetProp, A.SetAll)):
                    c.needs.setdefault(x.var, set())
        return c

    def count(self, what: str, n: int) -> None:
        if n:
            self.counts[what] = self.counts.get(what, 0) + n

    def run(self, query: A.Query) -> tuple[PropertyGraph, DataFrame]:
        c = self.compiler(query)
        rows = Rows(None)
        for clause in query.clauses:
            if isinstance(clause, A.Match):
                rows = c.match(rows, clause)
            elif isinstance(clause, A.Unwind):
                rows = c.unwind(rows, clause)
            elif isinstance(clause, A.Projection):
                rows = c.project(self.refreshed(c, rows), clause)
                if clause.final:
                    return self.graph, rows.df
            else:
                rows = c.base(rows)
                rows = Rows(cut(rows.df), rows.scope)
                if isinstance(clause, A.Create):
                    rows = self.create(c, rows, clause.paths)
                elif isinstance(clause, A.Merge):
                    rows = self.merge(c, rows, clause)
                elif isinstance(clause, A.Change):
                    self.change(c, rows, clause.items)
                else:
                    self.delete(rows, clause)
                c.graph = self.graph
        names = ("nodes_created", "relationships_created", "properties_set", "labels_changed", "nodes_deleted", "relationships_deleted")
        return self.graph, self.graph.spark.createDataFrame([tuple(self.counts.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))

    def refreshed(self, c: Compiler, rows: Rows) -> Rows:
        """Nodes and relationships as the graph holds them now."""
        df, scope = rows.df, {}
        for name, b in rows.scope.items():
            if b.kind == "node":
                known = self.graph.node_props()
                props = tuple(sorted(set(b.props) | {k for k in c.needs.get(name, ()) if k in known} | (set(known) if name in c.whole else set())))
                new = Binding("node", b.name, props, True)
                view = self.graph.node_view((), props).select(col("id").alias("·i"), col("labels").alias(new.c("labels")), *[col(k).alias(new.c("p:" + k)) for k in props])
            elif b.kind == "rel":
                known = self.graph.rel_props()
                props = tuple(sorted(set(b.props) | {k for k in c.needs.get(name, ()) if k in known} | (set(known) if name in c.whole else set())))
                new = Binding("rel", b.name, props)
                view = self.graph.rel_view((), props).select(col("id").alias("·i"), *[col(k).alias(new.c(k)) for k in ("src", "dst", "type")], *[col(k).alias(new.c("p:" + k)) for k in props])
            else:
                scope[name] = b
                continue
            df = df.drop(*[x for x in b.columns() if x != b.c("id")]).join(view, col(b.c("id")) == col("·i"), "left").drop("·i")
            scope[name] = new
        return Rows(df, scope)

    def values(self, c: Compiler, rows: Rows, props: tuple[tuple[str, A.Expr], ...]) -> dict[str, F.Column]:
        out = {}
        for k, e in props:
            v = c.expr(e, rows)
            t = c.type_of(v, rows)
            out[k] = F.to_json(v) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else v
        return out

    def numbered(self, df: DataFrame, name: str, first: int) -> DataFrame:
        """Ids for new rows: those of one task follow one another, and the tasks' offsets come from their counts."""
        rows = cut(df.withColumn("·task", F.spark_partition_id()).withColumn("·at", F.monotonically_increasing_id()))
        before = F.coalesce(F.sum("·n").over(Window.orderBy("·task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = rows.groupBy("·task").agg(F.count("*").alias("·n"), F.min("·at").alias("·first")).select(F.col("·task").alias("·t"), before.alias("·before"))
        rank = F.row_number().over(Window.partitionBy("·task").orderBy("·at")) - 1
        rows = rows.withColumn("·rank", rank).join(F.broadcast(offsets), F.col("`·task`") == F.col("`·t`"))  # one row a task
        return cut(rows.withColumn(name, (F.col("`·before`") + F.col("`·rank`") + first).cast("long")).drop("·task", "·at", "·rank", "·t", "·before"))

    def create(self, c: Compiler, rows: Rows, paths: tuple[A.Path, ...]) -> Rows:
        df, scope = rows.df, dict(rows.scope)
        for p in paths:
            places = []
            for n in p.nodes:
                if n.var and n.var in scope:
                    if n.labels or n.props:
                        raise CypherError(f"{n.var} exists already")
                    places.append(scope[n.var].c("id"))
                    continue
                b = Binding("node", n.var or c.name("n"))
                values = self.values(c, Rows(df, scope), n.props)
                df = self.numbered(df, b.c("id"), crud.next_id(self.graph, "node"))
                new = df.select(col(b.c("id")).alias("id"), *[v.alias(k) for k, v in values.items()])
                self.count("nodes_created", new.count())
                self.graph = self.graph.with_nodes(n.labels, new)
                scope[n.var or b.name] = b
                places.append(b.c("id"))
            for i, r in enumerate(p.rels):
                if len(r.types) != 1 or r.direction == "both" or r.hops:
                    raise CypherError("a new relationship needs one type and a direction")
                b = Binding("rel", r.var or c.name("r"))
                values = self.values(c, Rows(df, scope), r.props)
                df = self.numbered(df, b.c("id"), crud.next_id(self.graph, "rel"))
                a, z = (places[i], places[i + 1]) if r.direction == "out" else (places[i + 1], places[i])
                new = df.select(col(b.c("id")).alias("id"), col(a).alias("src"), col(z).alias("dst"), *[v.alias(k) for k, v in values.items()])
                self.count("relationships_created", new.count())
                self.graph = self.graph.with_rels(r.types[0], new)
                df = df.withColumn(b.c("src"), col(a)).withColumn(b.c("dst"), col(z)).withColumn(b.c("type"), F.lit(r.types[0]))
                scope[r.var or b.name] = b
        return Rows(df, scope)

    def merge(self, c: Compiler, rows: Rows, clause: A.Merge) -> Rows:
        """Rows that the path matches, and new elements for those that it does not; equal ones are made once."""
        p = clause.path
        new_vars = [x.var for x in (*p.nodes, *p.rels) if x.var and x.var not in rows.scope]
        keyed = self.numbered(rows.df, "·row", 0)
        base = Rows(keyed, rows.scope | {"·row": Binding("value", "·row")})
        c.graph = self.graph
        hit = c.match(base, A.Match((p,), False))
        hit = Rows(cut(hit.df), hit.scope)
        if clause.on_match:
            self.change(c, hit, clause.on_match)
        missing = keyed.join(hit.df.select("·row").distinct(), "·row", "left_anti")
        key_exprs = [c.expr(e, Rows(missing, rows.scope)) for n in (*p.nodes, *p.rels) for _, e in n.props]
        anchors = [col(rows.scope[n.var].c("id")) for n in p.nodes if n.var in rows.scope]
        groups = [k.alias(f"·k{i}") for i, k in enumerate([*anchors, *key_exprs])]
        missing = cut(missing.select("*", *groups))
        names = [f"·k{i}" for i in range(len(groups))]
        once = missing.withColumn("·n", F.row_number().over(Window.partitionBy(*(names or [F.lit(0)])).orderBy("·row"))).filter("`·n` = 1").drop("·n")
        made = self.create(c, Rows(cut(once), dict(rows.scope)), (p,))
        if clause.on_create:
            self.change(c, made, clause.on_create)
        columns = [x for v in new_vars for x in made.scope[v].columns() if x in made.df.columns]
        right = made.df.select(*[col(n).alias(n + "'") for n in names], *[col(x) for x in columns])
        on = F.lit(True)
        for n in names:
            on = on & col(n).eqNullSafe(col(n + "'"))
        filled = missing.join(right, on) if names else missing.crossJoin(right)
        scope = rows.scope | {v: made.scope[v] for v in new_vars}
        kept = [x for b in rows.scope.values() for x in b.columns()] + columns
        out = hit.df.select(*[col(x) for x in dict.fromkeys(kept)]).unionByName(filled.select(*[col(x) for x in dict.fromkeys(kept)])) if kept else hit.df
        return Rows(cut(out), scope)

    def change(self, c: Compiler, rows: Rows, items: tuple) -> None:
        for item in items:
            rows = self.refreshed(c, rows)
            var = item.var
            b = rows.scope.get(var)
            if b is None or b.kind not in ("node", "rel"):
                raise CypherError(f"{var} is no node or relationship")
            ids = rows.df.select(col(b.c("id")).alias("id")).filter("id IS NOT NULL")
            if isinstance(item, (A.SetLabels, A.RemoveLabels)):
                ids = cut(ids.distinct())
                self.count("labels_changed", ids.count())
                change = {"add" if isinstance(item, A.SetLabels) else "remove": item.labels}
                self.graph = crud.relabel(self.graph, ids, **change)
                continue
            if isinstance(item, A.SetAll):
                if not isinstance(item.expr, (A.MapOf, A.Param)):
                    raise CypherError("SET of a whole element takes a map")
                pairs = item.expr.items if isinstance(item.expr, A.MapOf) else tuple((k, A.Lit(v)) for k, v in self.params[item.expr.name].items())
                known = self.graph.node_props() if b.kind == "node" else self.graph.rel_props()
                gone = [k for k in known if item.replace and k not in dict(pairs)]
                self.change(c, rows, tuple([A.RemoveProp(var, k) for k in gone] + [A.SetProp(var, k, e) for k, e in pairs]))
                continue
            key = item.key
            value = self.values(c, rows, ((key, item.expr),))[key] if isinstance(item, A.SetProp) else F.lit(None)
            new = rows.df.select(col(b.c("id")).alias("id"), value.alias("·v")).filter("id IS NOT NULL")
            new = cut(new.groupBy("id").agg(F.max("·v").alias("·v")))
            self.count("properties_set", new.count())
            kind = new.schema["·v"].dataType
            keys = NODE_KEYS if b.kind == "node" else REL_KEYS
            tables = {}
            for name, df in (self.graph.nodes if b.kind == "node" else self.graph.rels).items():
                joined = df.join(new.withColumn("·hit", F.lit(True)), "id", "left")
                joined = crud.set_values(joined, keys, key, F.col("·v"), kind, F.col("·hit").isNotNull()).drop("·v", "·hit")
                tables[name] = joined if key in df.columns or new.join(df.select("id"), "id", "left_semi").limit(1).count() else df
            self.graph = self.graph.replaced(**{"nodes" if b.kind == "node" else "rels": tables})
            c.graph = self.graph

    def delete(self, rows: Rows, clause: A.Delete) -> None:
        node_ids, rel_ids = None, None
        for n in clause.names:
            b = rows.scope.get(n)
            if b is None or b.kind not in ("node", "rel"):
                raise CypherError(f"{n} is no node or relationship")
            ids = rows.df.select(col(b.c("id")).alias("id")).filter("id IS NOT NULL")
            if b.kind == "node":
                node_ids = ids if node_ids is None else node_ids.unionByName(ids)
            else:
                rel_ids = ids if rel_ids is None else rel_ids.unionByName(ids)
        if rel_ids is not None:
            rel_ids = cut(rel_ids.distinct())
            self.count("relationships_deleted", rel_ids.count())
            self.graph = crud.delete_rels(self.graph, rel_ids)
        if node_ids is not None:
            node_ids = cut(node_ids.distinct())
            self.count("nodes_deleted", node_ids.count())
            before = self.graph.rel_view((), ()).count() if clause.detach else 0
            self.graph = crud.delete_nodes(self.graph, node_ids, clause.detach)
            if clause.detach:
                self.count("relationships_deleted", before - self.graph.rel_view((), ()).count())
