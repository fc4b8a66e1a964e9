"""Reads query text into the classes of ``ast``."""

from __future__ import annotations

from . import ast as A
from .lexer import CypherError, Token, tokens

_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "UNION", "ORDER", "SKIP", "LIMIT", "ON"}
_COMPARE = {"=", "<>", "!=", "<", ">", "<=", ">=", "=~"}


class Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    # reading tokens
    @property
    def now(self) -> Token:
        return self.all[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.all[min(self.at + n, len(self.all) - 1)]

    def fail(self, wanted: str) -> CypherError:
        return CypherError(f"line {self.now.line}: expected {wanted}, found {self.now.text or 'the end'!r}")

    def take(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def op(self, *texts: str) -> bool:
        if self.now.kind == "op" and self.now.text in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(repr(text))

    def word(self, *words: str) -> bool:
        """Takes the words if they come next, all of them."""
        if all(self.ahead(i).word() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" ".join(words))

    def name(self, what: str = "a name") -> str:
        if self.now.kind not in ("name", "quoted"):
            raise self.fail(what)
        return self.take().text

    # statements
    def statement(self) -> A.Union:
        parts, every = [A.Query()], []
        while True:
            if self.now.kind == "end" or self.op(";"):
                break
            if self.word("UNION"):
                every.append(self.word("ALL"))
                parts.append(A.Query())
                continue
            parts[-1].clauses.append(self.clause())
        for part in parts:
            if not part.clauses:
                raise self.fail("a clause")
            for i, c in enumerate(part.clauses):
                if isinstance(c, A.Projection) and c.final and i + 1 < len(part.clauses):
                    raise CypherError("RETURN must come last")
        return A.Union(parts, every)

    def clause(self):
        if self.word("OPTIONAL", "MATCH"):
            return self.match(True)
        if self.word("MATCH"):
            return self.match(False)
        if self.word("RETURN"):
            return self.projection(True)
        if self.word("WITH"):
            return self.projection(False)
        if self.word("UNWIND"):
            expr = self.expr()
            self.need_word("AS")
            return A.Unwind(expr, self.name())
        if self.word("CREATE"):
            return A.Create(self.paths())
        if self.word("MERGE"):
            path, created, matched = self.path(), [], []
            while self.word("ON"):
                own = created if self.word("CREATE") else matched if self.word("MATCH") else None
                if own is None:
                    raise self.fail("CREATE or MATCH")
                self.need_word("SET")
                own += self.sets()
            return A.Merge(path, tuple(created), tuple(matched))
        if self.word("SET"):
            return A.Change(tuple(self.sets()))
        if self.word("REMOVE"):
            items = [self.removal()]
            while self.op(","):
                items.append(self.removal())
            return A.Change(tuple(items))
        detach = self.word("DETACH")
        if self.word("DELETE"):
            names = [self.name()]
            while self.op(","):
                names.append(self.name())
            return A.Delete(tuple(names), detach)
        raise self.fail("a clause")

    def match(self, optional: bool) -> A.Match:
        paths = self.paths()
        return A.Match(paths, optional, self.expr() if self.word("WHERE") else None)

    def projection(self, final: bool) -> A.Projection:
        distinct = self.word("DISTINCT")
        star, items = False, []
        if self.op("*"):
            star = True
            more = self.op(",")
        else:
            more = True
        while more:
            begin = self.at
            expr = self.expr()
            text = "".join(t.text if t.kind != "string" else repr(t.text) for t in self.all[begin : self.at])
            items.append(A.Item(expr, self.name("an alias") if self.word("AS") else expr.name if isinstance(expr, A.Var) else text))
            more = self.op(",")
        p = A.Projection(tuple(items), star, distinct, final=final)
        if self.word("ORDER", "BY"):
            order = []
            while True:
                expr = self.expr()
                descending = self.word("DESC") or self.word("DESCENDING")
                if not descending:
                    self.word("ASC") or self.word("ASCENDING")
                order.append(A.Order(expr, descending))
                if not self.op(","):
                    break
            p.order = tuple(order)
        if self.word("SKIP"):
            p.skip = self.expr()
        if self.word("LIMIT"):
            p.limit = self.expr()
        if not final and self.word("WHERE"):
            p.where = self.expr()
        return p

    def sets(self) -> list:
        out = [self.one_set()]
        while self.op(","):
            out.append(self.one_set())
        return out

    def one_set(self):
        var = self.name()
        if self.op("."):
            key = self.name()
            self.need("=")
            return A.SetProp(var, key, self.expr())
        if self.now.text == ":":
            return A.SetLabels(var, self.labels())
        merge = self.op("+=")
        if not merge:
            self.need("=")
        return A.SetAll(var, self.expr(), not merge)

    def removal(self):
        var = self.name()
        if self.op("."):
            return A.RemoveProp(var, self.name())
        labels = self.labels()
        if not labels:
            raise self.fail("'.' or ':'")
        return A.RemoveLabels(var, labels)

    # patterns
    def paths(self) -> tuple[A.Path, ...]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return tuple(out)

    def path(self) -> A.Path:
        var = None
        if self.now.kind in ("name", "quoted") and self.ahead().text == "=" and self.ahead().kind == "op":
            var = self.name()
            self.need("=")
        shortest = self.now.word() == "SHORTESTPATH"
        if shortest:
            self.take()
            self.need("(")
        nodes, rels = [self.node()], []
        while self.now.text in ("-", "<") and self.now.kind == "op":
            rels.append(self.rel())
            nodes.append(self.node())
        if shortest:
            self.need(")")
        return A.Path(var, tuple(nodes), tuple(rels), shortest)

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.op(":"):
            out.append(self.name("a label"))
        return tuple(out)

    def node(self) -> A.NodePattern:
        self.need("(")
        var = self.name() if self.now.kind in ("name", "quoted") else None
        labels, props = self.labels(), self.props()
        self.need(")")
        return A.NodePattern(var, labels, props)

    def props(self) -> tuple[tuple[str, A.Expr], ...]:
        return self.map_items() if self.now.kind == "op" and self.now.text == "{" else ()

    def map_items(self) -> tuple[tuple[str, A.Expr], ...]:
        self.need("{")
        out = []
        while not self.op("}"):
            if out:
                self.need(",")
            key = self.name("a key") if self.now.kind != "string" else self.take().text
            self.need(":")
            out.append((key, self.expr()))
        return tuple(out)

    def rel(self) -> A.RelPattern:
        back = self.op("<")
        self.need("-")
        var, types, props, hops = None, [], (), None
        if self.op("["):
            if self.now.kind in ("name", "quoted"):
                var = self.name()
            while self.op(":", "|"):
                self.op(":")
                types.append(self.name("a type"))
            if self.op("*"):
                hops = self.hops()
            props = self.props()
            self.need("]")
        self.need("-")
        forth = self.op(">")
        return A.RelPattern(var, tuple(types), props, "both" if back == forth else "in" if back else "out", hops)

    def hops(self) -> tuple[int, int | None]:
        low = int(self.take().text) if self.now.kind == "int" else None
        if self.op(".."):
            return (1 if low is None else low), (int(self.take().text) if self.now.kind == "int" else None)
        return (1, None) if low is None else (low, low)

    # expressions, loosest first
    def expr(self) -> A.Expr:
        x = self.xor()
        while self.word("OR"):
            x = A.Binary("OR", x, self.xor())
        return x

    def xor(self) -> A.Expr:
        x = self.conjunction()
        while self.word("XOR"):
            x = A.Binary("XOR", x, self.conjunction())
        return x

    def conjunction(self) -> A.Expr:
        x = self.negation()
        while self.word("AND"):
            x = A.Binary("AND", x, self.negation())
        return x

    def negation(self) -> A.Expr:
        return A.Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> A.Expr:
        first = x = self.sum()
        whole = None
        while True:
            if self.now.kind == "op" and self.now.text in _COMPARE:
                op = self.take().text
                y = self.sum()
                one = A.Binary("<>" if op == "!=" else op, x, y)
                whole = one if whole is None else A.Binary("AND", whole, one)
                x = y
                continue
            base = first if whole is None else whole
            if self.word("IS", "NOT", "NULL"):
                whole = A.Unary("IS NOT NULL", base)
            elif self.word("IS", "NULL"):
                whole = A.Unary("IS NULL", base)
            elif self.word("STARTS", "WITH"):
                whole = A.Binary("STARTS WITH", base, self.sum())
            elif self.word("ENDS", "WITH"):
                whole = A.Binary("ENDS WITH", base, self.sum())
            elif self.word("CONTAINS"):
                whole = A.Binary("CONTAINS", base, self.sum())
            elif self.word("IN"):
                whole = A.Binary("IN", base, self.sum())
            else:
                return base

    def sum(self) -> A.Expr:
        x = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-"):
            op = self.take().text
            x = A.Binary(op, x, self.product())
        return x

    def product(self) -> A.Expr:
        x = self.power()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.take().text
            x = A.Binary(op, x, self.power())
        return x

    def power(self) -> A.Expr:
        x = self.unary()
        return A.Binary("^", x, self.power()) if self.op("^") else x

    def unary(self) -> A.Expr:
        if self.op("-"):
            x = self.unary()
            return A.Lit(-x.value) if isinstance(x, A.Lit) and isinstance(x.value, (int, float)) else A.Unary("-", x)
        if self.op("+"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> A.Expr:
        x = self.atom()
        while True:
            if self.now.kind == "op" and self.now.text == ".":
                self.take()
                x = A.Prop(x, self.name("a property"))
            elif self.op("["):
                low = None if self.now.text == ".." else self.expr()
                if self.op(".."):
                    high = None if self.now.text == "]" else self.expr()
                    x = A.Index(x, low, high, True)
                else:
                    x = A.Index(x, low)
                self.need("]")
            elif isinstance(x, A.Var) and self.now.text == ":" and self.now.kind == "op":
                x = A.HasLabel(x.name, self.labels())
            else:
                return x

    def atom(self) -> A.Expr:
        t = self.now
        if t.kind == "int":
            return A.Lit(int(self.take().text))
        if t.kind == "float":
            return A.Lit(float(self.take().text))
        if t.kind == "string":
            return A.Lit(self.take().text)
        if t.kind == "param":
            return A.Param(self.take().text)
        if t.kind == "op" and t.text == "[":
            self.take()
            items = []
            while not self.op("]"):
                if items:
                    self.need(",")
                items.append(self.expr())
            return A.ListOf(tuple(items))
        if t.kind == "op" and t.text == "{":
            return A.MapOf(self.map_items())
        if t.kind == "op" and t.text == "(":
            return self.pattern_predicate() or self.parenthesis()
        if t.kind not in ("name", "quoted"):
            raise self.fail("an expression")
        word = t.word()
        if word in ("TRUE", "FALSE"):
            self.take()
            return A.Lit(word == "TRUE")
        if word == "NULL":
            self.take()
            return A.Lit(None)
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self.ahead().text == "{":
            self.take()
            self.take()
            self.word("MATCH")
            paths = self.paths()
            where = self.expr() if self.word("WHERE") else None
            self.need("}")
            return A.Exists(paths, where)
        if self.ahead().text == "(" and self.ahead().kind == "op":
            return self.call()
        if word in _CLAUSES and t.kind == "name":
            raise self.fail("an expression")
        return A.Var(self.name())

    def parenthesis(self) -> A.Expr:
        self.need("(")
        x = self.expr()
        self.need(")")
        return x

    def pattern_predicate(self) -> A.Expr | None:
        """A path where a truth value is wanted, if that is what the parenthesis begins."""
        begin = self.at
        try:
            path = self.path()
        except CypherError:
            path = None
        if path is None or not path.rels:
            self.at = begin
            return None
        return A.Exists((path,), None)

    def case(self) -> A.Expr:
        self.need_word("CASE")
        of = None if self.now.word() == "WHEN" else self.expr()
        whens = []
        while self.word("WHEN"):
            test = self.expr()
            self.need_word("THEN")
            whens.append((test, self.expr()))
        if not whens:
            raise self.fail("WHEN")
        default = self.expr() if self.word("ELSE") else None
        self.need_word("END")
        return A.Case(of, tuple(whens), default)

    def call(self) -> A.Expr:
        name = self.name()
        self.need("(")
        if self.op("*"):
            self.need(")")
            return A.Call(name.lower(), (), star=True)
        distinct = self.word("DISTINCT")
        args = []
        while not self.op(")"):
            if args:
                self.need(",")
            args.append(self.expr())
        return A.Call(name.lower(), tuple(args), distinct)


def parse(text: str) -> A.Union:
    return Parser(text).statement()
