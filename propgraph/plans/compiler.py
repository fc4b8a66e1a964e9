"""Turns a reading query into one DataFrame plan.

Clauses are stages over a row set with a scope of named bindings. Node and relationship patterns
become equi joins: undirected steps read both orientations of the edge table instead of joining on
either end. A node that needs no label check and no property is not scanned at all, its id comes
from the edge. Only properties that the query names are read. Everything is lazy, except that
variable-length patterns without an upper bound run level by level.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from ..graph import PropertyGraph, col
from . import ast as A
from .lexer import CypherError
from .parser import parse


@dataclass(frozen=True)
class Binding:
    """What a name stands for: columns of the row set.

    kind: node (columns id, labels, p:key), rel (id, src, dst, type, p:key), rels (ids of a
    variable-length step), path (nodes, rels) or value.
    """

    kind: str
    name: str
    props: tuple[str, ...] = ()
    labelled: bool = False

    def c(self, part: str = "") -> str:
        return f"{self.name}·{part}" if part else self.name

    def columns(self) -> list[str]:
        if self.kind == "node":
            return [self.c("id"), *([self.c("labels")] if self.labelled else []), *[self.c("p:" + k) for k in self.props]]
        if self.kind == "rel":
            return [self.c(x) for x in ("id", "src", "dst", "type")] + [self.c("p:" + k) for k in self.props]
        if self.kind == "path":
            return [self.c("nodes"), self.c("rels")]
        return [self.name]


@dataclass
class Rows:
    """A row set and its scope."""

    df: DataFrame | None
    scope: dict[str, Binding] = field(default_factory=dict)

    def typed(self) -> DataFrame:
        """The same columns over no rows: cheap to ask for types."""
        return self.df


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    return conjuncts(e.a) + conjuncts(e.b) if isinstance(e, A.Binary) and e.op == "AND" else [e]


def is_aggregate(e: A.Expr) -> bool:
    return any(isinstance(x, A.Call) and (x.name in registry.AGGREGATES or x.name == "group_concat") and not (x.name in ("min", "max") and len(x.args) > 1) for x in A.walk(e))


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict | None = None, semantics: str = "standard"):
        if semantics not in ("standard", "reference"):
            raise ValueError(semantics)
        self.graph, self.params, self.semantics = graph, params or {}, semantics
        self.fresh = itertools.count()
        self.needs: dict[str, set[str]] = {}
        self.whole: set[str] = set()
        self.early: dict[str, list[A.Expr]] = {}

    # what each name is used for
    def look(self, query: A.Query) -> None:
        same: list[tuple[str, str]] = []

        def note(e, inside: bool) -> None:
            if isinstance(e, A.Prop) and isinstance(e.of, A.Var):
                self.needs.setdefault(e.of.name, set()).add(e.key)
            elif isinstance(e, A.Var):
                self.whole.add(e.name)
            elif isinstance(e, A.HasLabel):
                self.needs.setdefault(e.of, set()).add("·labels")
            elif isinstance(e, A.Call) and len(e.args) == 1 and isinstance(e.args[0], A.Var) and e.name in ("id", "labels", "type", "count", "startnode", "endnode", "length", "nodes", "relationships", "size"):
                if e.name == "labels":
                    self.needs.setdefault(e.args[0].name, set()).add("·labels")
            elif isinstance(e, A.Unary) and e.op.startswith("IS") and isinstance(e.x, A.Var):
                pass
            elif isinstance(e, A.Binary) and e.op in ("=", "<>") and isinstance(e.a, A.Var) and isinstance(e.b, A.Var):
                pass
            elif isinstance(e, (list, tuple)):
                for x in e:
                    note(x, inside)
            elif isinstance(e, A.Projection):
                for item in e.items:
                    if isinstance(item.expr, A.Var) and not e.final:
                        same.append((item.alias, item.expr.name))
                    else:
                        note(item.expr, inside)
                note([o.expr for o in e.order if not isinstance(o.expr, A.Var)], inside)
                note(e.where, inside)
                if e.star and e.final:
                    self.whole.add("*")
            elif hasattr(e, "__dataclass_fields__"):
                if isinstance(e, (A.NodePattern, A.RelPattern)) and e.var:
                    for k, _ in e.props:
                        self.needs.setdefault(e.var, set()).add(k)
                for f in e.__dataclass_fields__:
                    note(getattr(e, f), inside)

        note(query.clauses, False)
        for _ in range(len(same) + 1):
            for new, old in same:
                self.needs.setdefault(old, set()).update(self.needs.get(new, ()))
                if new in self.whole:
                    self.whole.add(old)

    def wanted(self, var: str | None, known: dict, extra: tuple = ()) -> list[str]:
        if var and (var in self.whole or "*" in self.whole):
            return sorted(known)
        return sorted(k for k in {*self.needs.get(var or "", ()), *[k for k, _ in extra]} if k != "·labels")

    def name(self, hint: str) -> str:
        return f"{hint}·{next(self.fresh)}"

    # statements
    def statement(self, s: A.Union) -> DataFrame:
        out = self.single(s.parts[0])
        for part, keep in zip(s.parts[1:], s.all):
            more = self.single(part)
            if set(more.columns) != set(out.columns):
                raise CypherError("UNION needs the same column names on both sides")
            out = out.unionByName(more)
            if not keep:
                out = out.distinct()
        return out

    def single(self, query: A.Query) -> DataFrame:
        if any(isinstance(c, A.WRITES) for c in query.clauses):
            raise CypherError("a reading query may not write; use execute()")
        if not (isinstance(query.clauses[-1], A.Projection) and query.clauses[-1].final):
            raise CypherError("the query returns nothing; it must end in RETURN")
        return self.rows(query).df

    def rows(self, query: A.Query, upto: int | None = None) -> Rows:
        self.look(query)
        rows = Rows(None)
        for clause in query.clauses[:upto]:
            if isinstance(clause, A.Match):
                rows = self.match(rows, clause)
            elif isinstance(clause, A.Unwind):
                rows = self.unwind(rows, clause)
            elif isinstance(clause, A.Projection):
                rows = self.project(rows, clause)
        return rows

    def base(self, rows: Rows) -> Rows:
        return rows if rows.df is not None else Rows(self.graph.spark.range(1).select(F.lit(1).alias("·one")), rows.scope)

    # patterns
    def match(self, rows: Rows, clause: A.Match) -> Rows:
        paths, where = self.hoisted(clause.paths, clause.where)
        clause = A.Match(paths, clause.optional, where)
        pattern, shared = self.pattern(clause.paths, rows.scope, clause.where)
        extra = self.constraints(clause.paths, rows.scope)
        tests = conjuncts(clause.where)
        if rows.df is None:
            if clause.optional:
                rows = self.base(rows)
            else:
                return self.filter(pattern, tests)
        inner = {k: v for k, v in pattern.scope.items() if k not in rows.scope}
        right = pattern.df
        on = F.lit(True)
        for v in shared:
            key = self.name(v)
            right = right.withColumnRenamed(rows.scope[v].c("id"), key)
            on = on & (col(rows.scope[v].c("id")) == col(key))
        scope = rows.scope | inner
        used = [c for b in scope.values() for c in b.columns()]
        if not clause.optional:
            joined = rows.df.join(right, on) if shared else rows.df.crossJoin(right)
            out = Rows(joined, scope)
            for t in extra:
                out.df = out.df.filter(t(out))
            out = self.filter(out, tests)
            return Rows(out.df.select(*[col(c) for c in dict.fromkeys(used)]), out.scope)
        both = Rows(rows.df.limit(0).crossJoin(right.limit(0)), scope)
        simple = [t for t in tests if not isinstance(t, A.Exists) and not (isinstance(t, A.Unary) and isinstance(t.x, A.Exists))]
        for t in extra:
            on = on & t(both)
        if len(simple) < len(tests) or any(isinstance(x, A.Exists) for x in A.walk(simple)):
            # what matches is found over the distinct rows, existence tests by semi joins, and joined back to all rows
            keys = rows.df.distinct()
            hit = self.filter(Rows(keys.join(right, on), scope), tests).df
            same = F.lit(True)
            for c in rows.df.columns:
                key = self.name("k")
                hit = hit.withColumnRenamed(c, key)
                same = same & col(c).eqNullSafe(col(key))
            out = rows.df.join(hit, same, "left")
            return Rows(out.select(*[col(c) for c in dict.fromkeys(used)] or [col("·one")]), scope)
        for t in simple:
            on = on & self.expr(t, both)
        out = rows.df.join(right, on, "left")
        keep = [c for c in dict.fromkeys(used)] or ["·one"]
        return Rows(out.select(*[col(c) for c in keep]), scope)

    def constraints(self, paths: tuple[A.Path, ...], scope: dict[str, Binding]) -> list:
        """Labels and properties that a pattern asks of names bound before."""
        out = []
        for path in paths:
            for n in path.nodes:
                if n.var in scope and (n.labels or n.props):
                    e = [A.HasLabel(n.var, n.labels)] * bool(n.labels) + [A.Binary("=", A.Prop(A.Var(n.var), k), x) for k, x in n.props]
                    out += [lambda rows, x=x: self.expr(x, rows) for x in e]
        return out

    def pattern(self, paths: tuple[A.Path, ...], outer: dict[str, Binding], where: A.Expr | None = None) -> tuple[Rows, list[str]]:
        """Rows of all paths together, and the outer names they touch (by id only).

        Tests of ``where`` on one new node alone also go into its scan, where level-by-level steps start.
        """
        self.early = {}
        for t in conjuncts(where):
            names = {x.name for x in A.walk(t) if isinstance(x, A.Var)} | {x.of for x in A.walk(t) if isinstance(x, A.HasLabel)}
            if len(names) == 1 and not names & set(outer) and not any(isinstance(x, (A.Exists, A.HasLabel)) for x in A.walk(t)):
                self.early.setdefault(names.pop(), []).append(t)
        done: Rows | None = None
        shared: list[str] = []
        singles: list[tuple[Binding, tuple[str, ...]]] = []
        for path in _gathered(paths, outer):
            own = self.path(path, outer, done.scope if done else {}, shared, singles)
            if done is None:
                done = own
                continue
            common = [k for k in own.scope if k in done.scope]
            right, on = own.df, F.lit(True)
            for k in common:
                key = self.name(k)
                right = right.withColumnRenamed(own.scope[k].c("id"), key)
                on = on & (col(done.scope[k].c("id")) == col(key))
            df = done.df.join(right, on) if common else done.df.crossJoin(right)
            done = Rows(df, own.scope | done.scope)
        assert done is not None
        df = done.df
        for (a, ta), (b, tb) in itertools.combinations(singles, 2):
            if ta and tb and not set(ta) & set(tb):
                continue
            x, y = (col(s.c("id") if s.kind == "rel" else s.name) for s in (a, b))
            if a.kind == b.kind == "rel":
                df = df.filter(x != y)
            elif a.kind == "rels" and b.kind == "rels":
                df = df.filter(~F.arrays_overlap(x, y))
            else:
                df = df.filter(~(F.array_contains(x, y) if a.kind == "rels" else F.array_contains(y, x)))
        return Rows(df, done.scope), list(dict.fromkeys(shared))

    def scan(self, n: A.NodePattern, b: Binding) -> DataFrame:
        view = self.graph.node_view(n.labels, b.props)
        view = view.select(col("id").alias(b.c("id")), *([col("labels").alias(b.c("labels"))] if b.labelled else []), *[col(k).alias(b.c("p:" + k)) for k in b.props])
        rows = Rows(view, {n.var or "": b})
        for k, x in n.props:
            view = view.filter(self.compare("=", col(b.c("p:" + k)), self.expr(x, rows), rows))
        for t in self.early.get(n.var or "", ()):
            view = view.filter(self.expr(t, rows))
        return view

    def bind_node(self, n: A.NodePattern) -> Binding:
        known = self.graph.node_props(n.labels)
        labelled = bool(n.var) and ("·labels" in self.needs.get(n.var, ()) or n.var in self.whole or "*" in self.whole)
        return Binding("node", n.var or self.name("n"), tuple(self.wanted(n.var, known, n.props)), labelled)

    def implied(self, n: A.NodePattern, rels: list[tuple[A.RelPattern, str]]) -> bool:
        """Whether some step already guarantees the node's labels. ``rels``: (step, which end this node is)."""
        if not n.labels:
            return True
        for r, end in rels:
            if r.hops or r.direction == "both" or not r.types:
                continue
            side = 0 if (r.direction == "out") == (end == "left") else 1
            if all(t in self.graph.ends and set(n.labels) <= self.graph.ends[t][side] for t in r.types):
                return True
        return False

    def path(self, p: A.Path, outer: dict[str, Binding], local: dict[str, Binding], shared: list[str], singles: list) -> Rows:
        """One path. ``local``: what other paths of the clause have bound; like ``outer`` it is met by id."""
        scope: dict[str, Binding] = {}
        df: DataFrame | None = None
        hops: list[tuple[Binding, bool]] = []
        previous: Binding | None = None

        def node(i: int) -> tuple[Binding, bool]:
            """The binding, and whether the node must be scanned."""
            n = p.nodes[i]
            if n.var and n.var in scope:
                return scope[n.var], False
            if n.var and (n.var in outer or n.var in local):
                if (local.get(n.var) or outer[n.var]).kind != "node":
                    raise CypherError(f"{n.var} is not a node")
                if n.var not in local:
                    shared.append(n.var)
                    scope[n.var] = Binding("node", outer[n.var].name)
                    return scope[n.var], False
                scope[n.var] = Binding("node", local[n.var].name)
                return scope[n.var], False
            b = self.bind_node(n)
            near = [(r, "left") for r in p.rels[i : i + 1]] + [(r, "right") for r in p.rels[i - 1 : i] if i]
            scan = bool(b.props or b.labelled or n.props) or not near or not self.implied(n, near)
            if not scan:
                b = replace(b, props=(), labelled=False)
            scope[n.var or b.name] = b
            return b, scan

        first, scan_first = node(0)
        if not p.rels:
            if p.nodes[0].var in outer or p.nodes[0].var in local:
                view = self.graph.node_view((), ())
                return Rows(view.select(col("id").alias(first.c("id"))), scope)
            df = self.scan(p.nodes[0], first)
        elif scan_first:
            df = self.scan(p.nodes[0], first)
        previous = first
        for i, r in enumerate(p.rels):
            seen = p.nodes[i + 1].var is not None and p.nodes[i + 1].var in scope
            following, scan = node(i + 1)
            b, steps = self.step(r, df, previous, p)
            if r.var and (r.var in scope or r.var in outer or r.var in local):
                raise CypherError(f"{r.var} is already bound")
            scope[r.var or b.name] = b
            singles.append((b, r.types))
            start, end = self.name("a"), self.name("b")
            steps = steps.withColumnRenamed("·from", start).withColumnRenamed("·to", end)
            if df is None:
                df = steps.withColumn(previous.c("id"), col(start)).drop(start)
            else:
                df = df.join(steps, col(previous.c("id")) == col(start)).drop(start)
            if seen:
                df = df.filter(col(following.c("id")) == col(end)).drop(end)
            elif scan:
                df = df.join(self.scan(p.nodes[i + 1], following), col(end) == col(following.c("id"))).drop(end)
            else:
                df = df.withColumnRenamed(end, following.c("id"))
            hops.append((b, r.hops is not None or p.shortest))
            previous = following
        if p.var:
            unnamed = iter([b for k, b in scope.items() if b.kind == "node" and k == b.name and "·" in k])
            places = [(scope[n.var] if n.var else next(unnamed)).c("id") for n in p.nodes]
            nodes, rels = F.array(col(places[0])), F.array().cast("array<bigint>")
            for (b, var), place in zip(hops, places[1:]):
                if var:
                    nodes = F.concat(nodes, col(b.name + "·via"), F.when(F.size(col(b.name)) > 0, F.array(col(place))).otherwise(F.array().cast("array<bigint>")))
                    rels = F.concat(rels, col(b.name))
                else:
                    nodes, rels = F.concat(nodes, F.array(col(place))), F.concat(rels, F.array(col(b.c("id"))))
            path = Binding("path", p.var)
            df = df.withColumn(path.c("nodes"), nodes).withColumn(path.c("rels"), rels)
            scope[p.var] = path
        return Rows(df, scope)

    def edges(self, r: A.RelPattern, b: Binding) -> DataFrame:
        view = self.graph.rel_view(r.types, b.props)
        view = view.select(*[col(k).alias(b.c(k)) for k in ("id", "src", "dst", "type")], *[col(k).alias(b.c("p:" + k)) for k in b.props])
        rows = Rows(view, {r.var or "": b})
        for k, x in r.props:
            view = view.filter(self.compare("=", col(b.c("p:" + k)), self.expr(x, rows), rows))
        src, dst = col(b.c("src")), col(b.c("dst"))
        out = view.select("*", src.alias("·from"), dst.alias("·to"))
        back = view.select("*", dst.alias("·from"), src.alias("·to"))
        if r.direction == "out":
            return out
        return back if r.direction == "in" else out.unionByName(back.filter(src != dst))

    def step(self, r: A.RelPattern, start: DataFrame | None, first: Binding, p: A.Path) -> tuple[Binding, DataFrame]:
        known = self.graph.rel_props(r.types)
        one = Binding("rel", r.var or self.name("r"), tuple(self.wanted(r.var if not r.hops else None, known, r.props)))
        if not r.hops and not p.shortest:
            return one, self.edges(r, one)
        own = replace(one, name=self.name("e"))
        flat = self.edges(r, own).select("·from", "·to", col(own.c("id")).alias("·id"))
        low, high = r.hops or (1, 1)
        starts = start.select(col(first.c("id")).alias("·from")).distinct() if start is not None else None
        b = Binding("rels", one.name)
        found = self.shortest(flat, starts, low, high) if p.shortest else self.trails(flat, starts, low, high)
        return b, found.select("·from", "·to", col("·rels").alias(b.name), col("·via").alias(b.name + "·via"))

    def trails(self, flat: DataFrame, starts: DataFrame | None, low: int, high: int | None) -> DataFrame:
        """Paths of ``low`` to ``high`` steps that use no relationship twice."""
        if low == 0 and starts is None:
            starts = self.graph.node_view((), ()).select(col("id").alias("·from"))
        begin = flat.join(starts, "·from", "left_semi") if starts is not None else flat
        none = F.array().cast("array<bigint>")
        level = begin.select("·from", "·to", F.array("·id").alias("·rels"), none.alias("·via"))
        parts = [starts.select("·from", col("·from").alias("·to"), none.alias("·rels"), none.alias("·via"))] if low == 0 else []
        edges = flat.select(col("·from").alias("·at"), col("·to").alias("·next"), "·id")
        depth = 1
        while high is None or depth <= high:
            if depth >= low:
                parts.append(level)
            if depth == high:
                break
            longer = level.join(edges, col("·to") == col("·at")).filter(~F.array_contains("·rels", col("·id")))
            level = longer.select("·from", col("·next").alias("·to"), F.concat("·rels", F.array("·id")).alias("·rels"), F.concat("·via", F.array("·to")).alias("·via"))
            depth += 1
            if high is None:  # ends: no trail has more steps than there are relationships
                from ..operators.common import cut

                level = cut(level)
                if level.isEmpty():
                    break
        out = parts[0] if parts else level.limit(0)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def shortest(self, flat: DataFrame, starts: DataFrame | None, low: int, high: int | None) -> DataFrame:
        """One shortest path for each pair, the least by its nodes; level by level."""
        from ..operators.common import cut

        begin = flat.join(starts, "·from", "left_semi") if starts is not None else flat
        none = F.array().cast("array<bigint>")
        pick = F.min(F.struct("·via", "·rels")).alias("best")

        def least(level: DataFrame) -> DataFrame:
            return level.filter("`·from` <> `·to`").groupBy("·from", "·to").agg(pick).select("·from", "·to", "best.*")

        level = cut(least(begin.select("·from", "·to", F.array("·id").alias("·rels"), none.alias("·via"))))
        edges = flat.select(col("·from").alias("·at"), col("·to").alias("·next"), "·id")
        done, depth = level, 1
        while (high is None or depth < high) and not level.isEmpty():
            depth += 1
            longer = level.join(edges, col("·to") == col("·at"))
            longer = longer.select("·from", col("·next").alias("·to"), F.concat("·rels", F.array("·id")).alias("·rels"), F.concat("·via", F.array("·to")).alias("·via"))
            level = cut(least(longer.join(done, ["·from", "·to"], "left_anti")))
            done = done.unionByName(level)
        return done

    # filters
    def filter(self, rows: Rows, tests: list[A.Expr]) -> Rows:
        """Keeps rows that meet all tests; existence tests that stand alone become semi and anti joins."""
        for t in tests:
            negated = isinstance(t, A.Unary) and t.op == "NOT" and isinstance(t.x, A.Exists)
            e = t.x if negated else t
            if isinstance(e, A.Exists):
                right, on = self.exists(e, rows)
                rows = Rows(rows.df.join(right, on, "left_anti" if negated else "left_semi"), rows.scope)
            elif any(isinstance(x, A.Exists) for x in A.walk(t)):
                rows, t = self.flagged(rows, t)
                rows = Rows(rows.df.filter(self.expr(t, rows)), rows.scope)
            else:
                rows = Rows(rows.df.filter(self.truth(t, rows)), rows.scope)
        return rows

    def truth(self, e: A.Expr, rows: Rows) -> Column:
        return self.as_bool(self.expr(e, rows), rows)

    def hoisted(self, paths: tuple[A.Path, ...], where: A.Expr | None) -> tuple[tuple[A.Path, ...], A.Expr | None]:
        """Properties in a pattern that name other variables become tests beside it."""
        tests: list[A.Expr] = []

        def plain(x):
            moved = [(k, e) for k, e in x.props if any(isinstance(v, A.Var) for v in A.walk(e))]
            if not moved:
                return x
            var = x.var or self.name("h")
            for k, e in moved:
                self.needs.setdefault(var, set()).add(k)
                tests.append(A.Binary("=", A.Prop(A.Var(var), k), e))
            return replace(x, var=var, props=tuple(p for p in x.props if p not in moved))

        out = tuple(replace(p, nodes=tuple(map(plain, p.nodes)), rels=tuple(map(plain, p.rels))) for p in paths)
        for t in tests:
            where = t if where is None else A.Binary("AND", where, t)
        return out, where

    def exists(self, e: A.Exists, rows: Rows) -> tuple[DataFrame, Column]:
        e = A.Exists(*self.hoisted(e.paths, e.where))
        pattern, shared = self.pattern(e.paths, rows.scope, e.where)
        right, on = pattern.df, F.lit(True)
        for v in shared:
            key = self.name(v)
            right = right.withColumnRenamed(rows.scope[v].c("id"), key)
            on = on & (col(rows.scope[v].c("id")) == col(key))
        scope = rows.scope | {k: v for k, v in pattern.scope.items() if k not in rows.scope}
        both = Rows(rows.df.limit(0).crossJoin(right.limit(0)), scope)
        for t in self.constraints(e.paths, rows.scope):
            on = on & t(both)
        for t in conjuncts(e.where):
            on = on & self.expr(t, both)
        return right, on

    def flagged(self, rows: Rows, e: A.Expr) -> tuple[Rows, A.Expr]:
        """Existence tests inside an expression become flag columns, found over the distinct ids they touch."""
        found = [x for x in A.walk(e) if isinstance(x, A.Exists)]
        swap: dict[A.Expr, A.Expr] = {}
        for x in found:
            inner = {n.var for p in x.paths for n in p.nodes if n.var in rows.scope}
            used = {v.name for v in A.walk(x.where) if isinstance(v, A.Var) and v.name in rows.scope} | inner
            columns = list(dict.fromkeys(c for v in used for c in rows.scope[v].columns()))
            keys = rows.df.select(*[col(c) for c in columns]).distinct()
            right, on = self.exists(x, Rows(keys, rows.scope))
            flag = self.name("x")
            hits = keys.join(right, on, "left_semi").withColumn(flag, F.lit(True))
            names = [self.name("k") for _ in columns]
            for c, n in zip(columns, names):
                hits = hits.withColumnRenamed(c, n)
            test = F.lit(True)
            for c, n in zip(columns, names):
                test = test & col(c).eqNullSafe(col(n))
            df = rows.df.join(hits, test, "left").drop(*names)
            df = df.withColumn(flag, F.coalesce(col(flag), F.lit(False)))
            rows = Rows(df, rows.scope | {flag: Binding("value", flag)})
            swap[x] = A.Var(flag)
        return rows, _swapped(e, swap)

    # projections
    def unwind(self, rows: Rows, clause: A.Unwind) -> Rows:
        rows = self.base(rows)
        if clause.var in rows.scope:
            raise CypherError(f"{clause.var} is already bound")
        value = self.expr(clause.expr, rows)
        if not isinstance(self.type_of(value, rows), T.ArrayType):
            value = F.array(value)
        return Rows(rows.df.withColumn(clause.var, F.explode(value)), rows.scope | {clause.var: Binding("value", clause.var)})

    def project(self, rows: Rows, p: A.Projection) -> Rows:
        rows = self.base(rows)
        items = list(p.items)
        if p.star:
            items = [A.Item(A.Var(k), k) for k in rows.scope if "·" not in k] + items
        if len({i.alias for i in items}) < len(items):
            raise CypherError("a column name occurs twice")
        for i, item in enumerate(items):
            if any(isinstance(x, A.Exists) for x in A.walk(item.expr)):
                rows, e = self.flagged(rows, item.expr)
                items[i] = A.Item(e, item.alias)
        scope: dict[str, Binding] = {}
        plain: list[tuple[str, Column]] = []
        summed: list[tuple[str, Column]] = []
        grouped = any(is_aggregate(i.expr) for i in items)
        for item in items:
            b = rows.scope.get(item.expr.name) if isinstance(item.expr, A.Var) else None
            if b is not None and b.kind in ("node", "rel", "path", "rels") and not p.final:
                new = replace(b, name=item.alias)
                plain += [(n, col(o)) for n, o in zip(new.columns(), b.columns())]
                scope[item.alias] = new
            else:
                (summed if is_aggregate(item.expr) else plain).append((item.alias, self.expr(item.expr, rows)))
                scope[item.alias] = Binding("value", item.alias)
        order: list[tuple[str, bool]] = []
        hidden: list[str] = []
        for o in p.order:
            alias = next((i.alias for i in items if i.expr == o.expr or (isinstance(o.expr, A.Var) and o.expr.name == i.alias)), None)
            if alias is None or alias not in scope or scope[alias].kind != "value":
                b = scope.get(alias or "")
                if b is not None:
                    alias = b.c("id") if b.kind in ("node", "rel") else b.columns()[0]
                else:
                    e = self.aliased(o.expr, items)
                    if p.distinct:
                        raise CypherError("ORDER BY after DISTINCT may only use returned columns")
                    alias = self.name("o")
                    hidden.append(alias)
                    (summed if is_aggregate(e) else plain).append((alias, self.expr(e, rows)))
            order.append((alias, o.descending))
        if grouped:
            stray = [h for h in hidden if h in dict(plain)]
            if stray:
                raise CypherError("ORDER BY of an aggregating projection may only use returned columns and aggregates")
            keys = [c.alias(n) for n, c in plain]
            values = [c.alias(n) for n, c in summed]
            df = rows.df.groupBy(*keys).agg(*values) if keys else rows.df.agg(*values)
            df = df.select(*[col(n) for n in self._in_order(items, scope, hidden)])
        else:
            df = rows.df.select(*[c.alias(n) for n, c in plain])
            if p.distinct:
                df = df.distinct()
        if grouped and p.distinct:
            df = df.distinct()
        out = Rows(df, scope)
        if p.where is not None:
            out = self.filter(out, conjuncts(p.where))
        if order:
            out.df = out.df.orderBy(*[col(n).desc_nulls_last() if d else col(n).asc_nulls_first() for n, d in order])
        if p.skip is not None:
            out.df = out.df.offset(self.constant(p.skip, "SKIP"))
        if p.limit is not None:
            out.df = out.df.limit(self.constant(p.limit, "LIMIT"))
        if hidden:
            out.df = out.df.drop(*hidden)
        return out

    def _in_order(self, items: list[A.Item], scope: dict[str, Binding], hidden: list[str]) -> list[str]:
        return [c for i in items for c in scope[i.alias].columns()] + hidden

    def aliased(self, e: A.Expr, items: list[A.Item]) -> A.Expr:
        """Names of returned columns inside an ORDER BY expression stand for what they return."""
        return _swapped(e, {A.Var(i.alias): i.expr for i in items})

    def constant(self, e: A.Expr, what: str) -> int:
        value = self.params.get(e.name) if isinstance(e, A.Param) else e.value if isinstance(e, A.Lit) else None
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise CypherError(f"{what} takes a whole number")
        return value

    # expressions
    def type_of(self, c: Column, rows: Rows) -> T.DataType:
        return rows.df.select(c.alias("x")).schema[0].dataType

    def binding(self, name: str, rows: Rows) -> Binding:
        if name not in rows.scope:
            raise CypherError(f"{name} is not defined")
        return rows.scope[name]

    def expr(self, e: A.Expr, rows: Rows) -> Column:
        return getattr(self, "_" + type(e).__name__.lower())(e, rows)

    def literal(self, v) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self.literal(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()])
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long")
        return F.lit(v)

    def _lit(self, e: A.Lit, rows: Rows) -> Column:
        return self.literal(e.value)

    def _param(self, e: A.Param, rows: Rows) -> Column:
        if e.name not in self.params:
            raise CypherError(f"no value for ${e.name}")
        return self.literal(self.params[e.name])

    def _var(self, e: A.Var, rows: Rows) -> Column:
        b = self.binding(e.name, rows)
        if b.kind == "node":
            whole = [col(b.c("id")).alias("id")] + ([col(b.c("labels")).alias("labels")] if b.labelled else []) + [col(b.c("p:" + k)).alias(k) for k in b.props]
            return F.when(col(b.c("id")).isNotNull(), F.struct(*whole))
        if b.kind == "rel":
            whole = [col(b.c(k)).alias(k) for k in ("id", "src", "dst", "type")] + [col(b.c("p:" + k)).alias(k) for k in b.props]
            return F.when(col(b.c("id")).isNotNull(), F.struct(*whole))
        if b.kind == "path":
            return F.struct(col(b.c("nodes")).alias("nodes"), col(b.c("rels")).alias("rels"))
        return col(b.name)

    def _prop(self, e: A.Prop, rows: Rows) -> Column:
        if isinstance(e.of, A.Var):
            b = self.binding(e.of.name, rows)
            if b.kind in ("node", "rel"):
                return col(b.c("p:" + e.key)) if e.key in b.props else F.lit(None).cast("string")
        of = self.expr(e.of, rows)
        t = self.type_of(of, rows)
        if isinstance(t, T.StructType):
            return of[e.key] if e.key in t.names else F.lit(None)
        if isinstance(t, T.MapType):
            return F.try_element_at(of, F.lit(e.key))
        if isinstance(t, T.StringType):
            return F.get_json_object(of, f"$.{e.key}")
        if isinstance(t, T.NullType):
            return F.lit(None)
        raise CypherError(f".{e.key} of a value that holds no properties")

    def _index(self, e: A.Index, rows: Rows) -> Column:
        of = self.expr(e.of, rows)
        if e.slice:
            size = F.size(of)

            def place(x: A.Expr | None, default: Column) -> Column:
                if x is None:
                    return default
                at = self.expr(x, rows).cast("int")
                return F.least(F.greatest(F.when(at < 0, at + size).otherwise(at), F.lit(0)), size)

            a, b = place(e.at, F.lit(0)), place(e.end, size)
            return F.slice(of, a + 1, F.greatest(b - a, F.lit(0)))
        t = self.type_of(of, rows)
        at = self.expr(e.at, rows)
        if isinstance(t, T.MapType):
            return F.try_element_at(of, at)
        if isinstance(t, T.StructType) and isinstance(e.at, A.Lit):
            return of[e.at.value] if e.at.value in t.names else F.lit(None)
        at = at.cast("int")
        return F.try_element_at(of, F.when(at >= 0, at + 1).otherwise(at))

    def _listof(self, e: A.ListOf, rows: Rows) -> Column:
        return F.array(*[self.expr(x, rows) for x in e.items])

    def _mapof(self, e: A.MapOf, rows: Rows) -> Column:
        return F.struct(*[self.expr(x, rows).alias(k) for k, x in e.items])

    def _haslabel(self, e: A.HasLabel, rows: Rows) -> Column:
        b = self.binding(e.of, rows)
        if b.kind != "node":
            raise CypherError(f"{e.of} is not a node")
        if not b.labelled:
            raise CypherError(f"labels of {e.of} are not at hand")
        out = F.lit(True)
        for x in e.labels:
            out = out & F.array_contains(col(b.c("labels")), x)
        return out

    def _unary(self, e: A.Unary, rows: Rows) -> Column:
        if e.op.startswith("IS"):
            b = rows.scope.get(e.x.name) if isinstance(e.x, A.Var) else None
            x = col(b.c("id")) if b and b.kind in ("node", "rel") else self.expr(e.x, rows)
            return x.isNull() if e.op == "IS NULL" else x.isNotNull()
        x = self.expr(e.x, rows)
        return ~self.as_bool(x, rows) if e.op == "NOT" else -x

    def as_bool(self, x: Column, rows: Rows) -> Column:
        t = self.type_of(x, rows)
        if isinstance(t, T.BooleanType):
            return x
        if isinstance(t, T.NullType):
            return x.cast("boolean")
        if self.semantics == "reference" and isinstance(t, T.NumericType):
            return x != 0
        raise CypherError("a truth value is wanted")

    def _binary(self, e: A.Binary, rows: Rows) -> Column:
        if e.op in ("AND", "OR", "XOR"):
            a, b = (self.as_bool(self.expr(x, rows), rows) for x in (e.a, e.b))
            return a & b if e.op == "AND" else a | b if e.op == "OR" else a != b
        if e.op in ("=", "<>") and isinstance(e.a, A.Var) and isinstance(e.b, A.Var):
            x, y = self.binding(e.a.name, rows), self.binding(e.b.name, rows)
            if x.kind in ("node", "rel") and y.kind == x.kind:
                same = col(x.c("id")) == col(y.c("id"))
                return same if e.op == "=" else ~same
        a = self.expr(e.a, rows)
        if e.op == "IN":
            return self.member(a, e.b, rows)
        b = self.expr(e.b, rows)
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            return self.compare(e.op, a, b, rows)
        if e.op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return self.text_test(e.op, a, b)
        if e.op == "=~":
            return F.call_function("rlike", a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        return self.arithmetic(e.op, a, b, rows)

    def member(self, a: Column, b: A.Expr, rows: Rows) -> Column:
        if isinstance(b, A.ListOf):
            values = [self.expr(x, rows) for x in b.items]
            t = self.type_of(a, rows)
            fit = [v for v in values if self.comparable(t, self.type_of(v, rows))]
            if not fit:
                return F.when(a.isNotNull() if values else F.lit(True), F.lit(False))
            return a.isin(*fit)
        values = self.expr(b, rows)
        if not isinstance(self.type_of(values, rows), T.ArrayType):
            raise CypherError("IN takes a list")
        return F.array_contains(values, a)

    @staticmethod
    def comparable(a: T.DataType, b: T.DataType) -> bool:
        def kind(t: T.DataType) -> str:
            if isinstance(t, T.NumericType):
                return "number"
            if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                return "time"
            return type(t).__name__

        return isinstance(a, T.NullType) or isinstance(b, T.NullType) or kind(a) == kind(b) or {kind(a), kind(b)} == {"time", "StringType"}

    def compare(self, op: str, a: Column, b: Column, rows: Rows) -> Column:
        ta, tb = self.type_of(a, rows), self.type_of(b, rows)
        if self.semantics == "reference":
            a, ta = (a.cast("long"), T.LongType()) if isinstance(ta, T.BooleanType) else (a, ta)
            b, tb = (b.cast("long"), T.LongType()) if isinstance(tb, T.BooleanType) else (b, tb)
            if not self.comparable(ta, tb):  # numbers sort before text
                first = isinstance(ta, T.NumericType)
                verdict = {"=": False, "<>": True, "<": first, "<=": first, ">": not first, ">=": not first}[op]
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(verdict))
        elif not self.comparable(ta, tb):
            return F.lit(None).cast("boolean")
        if isinstance(ta, T.StringType) and isinstance(tb, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            a = a.try_cast(tb)
        if isinstance(tb, T.StringType) and isinstance(ta, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            b = b.try_cast(ta)
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def text_test(self, op: str, a: Column, b: Column) -> Column:
        a, b = a.cast("string"), b.cast("string")
        if self.semantics == "reference":  # a pattern match without regard to case, with live wildcards
            pattern = {"STARTS WITH": F.concat(b, F.lit("%")), "ENDS WITH": F.concat(F.lit("%"), b), "CONTAINS": F.concat(F.lit("%"), b, F.lit("%"))}[op]
            return F.call_function("ilike", a, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))
        return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a, b)

    def arithmetic(self, op: str, a: Column, b: Column, rows: Rows) -> Column:
        ta, tb = self.type_of(a, rows), self.type_of(b, rows)
        if op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                return F.concat(a if isinstance(ta, T.ArrayType) else F.array(a), b if isinstance(tb, T.ArrayType) else F.array(b))
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                if self.semantics == "reference":
                    return F.coalesce(a.try_cast("double"), F.when(a.isNotNull(), 0.0)) + F.coalesce(b.try_cast("double"), F.when(b.isNotNull(), 0.0))
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "^":
            return F.pow(a, b)
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        if op == "/":
            return F.try_divide(a - F.try_mod(a, b), b).cast("long") if whole else F.try_divide(a, b)
        return F.try_mod(a, b)

    def _case(self, e: A.Case, rows: Rows) -> Column:
        out = None
        of = self.expr(e.of, rows) if e.of is not None else None
        for test, value in e.whens:
            t = self.expr(test, rows) if of is None else self.compare("=", of, self.expr(test, rows), rows)
            v = self.expr(value, rows)
            out = F.when(t, v) if out is None else out.when(t, v)
        return out if e.default is None else out.otherwise(self.expr(e.default, rows))

    def _exists(self, e: A.Exists, rows: Rows) -> Column:
        raise CypherError("a pattern may not stand here")

    def _call(self, e: A.Call, rows: Rows) -> Column:
        first = rows.scope.get(e.args[0].name) if e.args and isinstance(e.args[0], A.Var) else None
        kind = first.kind if first else ""
        n = e.name
        if n == "count" and (e.star or not e.args):
            return F.count(F.lit(1))
        if n == "exists" and len(e.args) == 1:
            return self.expr(e.args[0], rows).isNotNull()
        if n == "id" and kind in ("node", "rel"):
            return col(first.c("id"))
        if n == "count" and kind in ("node", "rel"):
            return registry.AGGREGATES["count"](col(first.c("id")), e.distinct)
        if n == "labels" and kind == "node":
            return col(first.c("labels"))
        if n == "type" and kind == "rel":
            return col(first.c("type"))
        if n in ("startnode", "endnode") and kind == "rel":
            return col(first.c("src" if n == "startnode" else "dst"))
        if n == "properties" and kind in ("node", "rel"):
            return F.struct(*[col(first.c("p:" + k)).alias(k) for k in first.props]) if first.props else F.lit(None)
        if n == "keys" and kind in ("node", "rel"):
            return F.array_compact(F.array(*[F.when(col(first.c("p:" + k)).isNotNull(), F.lit(k)) for k in first.props])) if first.props else F.array().cast("array<string>")
        if kind == "path" and n in ("nodes", "relationships", "rels", "length"):
            return F.size(col(first.c("rels"))).cast("long") if n == "length" else col(first.c("nodes" if n == "nodes" else "rels"))
        if n in ("size", "length") and e.args:
            x = self.expr(e.args[0], rows)
            return (F.size(x) if isinstance(self.type_of(x, rows), (T.ArrayType, T.MapType)) else F.length(x)).cast("long")
        args = [self.expr(x, rows) for x in e.args]
        if n == "group_concat":
            return registry.group_concat(args[0], args[1] if len(args) > 1 else None, e.distinct)
        if n in ("min", "max") and len(args) > 1:
            return (F.least if n == "min" else F.greatest)(*args)
        if n in registry.AGGREGATES:
            return registry.AGGREGATES[n](args[0], e.distinct)
        if n == "json_set" or n == "json_remove" or n == "json_patch":
            from ..functions.json_text import FUNCTIONS

            return FUNCTIONS[n](*args)
        if n not in registry.SCALARS:
            raise CypherError(f"no function {n}()")
        try:
            return registry.SCALARS[n](*args)
        except TypeError as error:
            raise CypherError(f"{n}() does not take {len(args)} arguments") from error


def _gathered(paths: tuple[A.Path, ...], outer: dict[str, Binding]) -> list[A.Path]:
    """The paths with all that is asked of a name said where it first occurs."""
    labels: dict[str, dict[str, None]] = {}
    props: dict[str, dict[tuple, None]] = {}
    for p in paths:
        for n in p.nodes:
            if n.var:
                labels.setdefault(n.var, {}).update(dict.fromkeys(n.labels))
                props.setdefault(n.var, {}).update(dict.fromkeys(n.props))
    met, out = set(), []
    for p in paths:
        nodes = []
        for n in p.nodes:
            if n.var and n.var not in outer:
                first = n.var not in met
                n = A.NodePattern(n.var, tuple(labels[n.var]) if first else (), tuple(props[n.var]) if first else ())
                met.add(n.var)
            nodes.append(n)
        out.append(replace(p, nodes=tuple(nodes)))
    return out


def _swapped(e, swap: dict):
    """``e`` with expressions replaced, wherever they stand in it."""
    if isinstance(e, A.Expr) and e in swap:
        return swap[e]
    if isinstance(e, tuple):
        return tuple(_swapped(x, swap) for x in e)
    if isinstance(e, A.Expr):
        return replace(e, **{f: _swapped(getattr(e, f), swap) for f in e.__dataclass_fields__})
    return e


def read_query(graph: PropertyGraph, text: str, params: dict | None = None, semantics: str = "standard") -> DataFrame:
    return Compiler(graph, params, semantics).statement(parse(text))
