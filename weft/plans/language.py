"""A reading graph query language over nodes and edges, compiled to DataFrame plans.

``MATCH``, ``OPTIONAL MATCH``, ``WHERE``, ``WITH``, ``UNWIND``, ``CALL .. YIELD``, ``RETURN [DISTINCT]``, ``ORDER BY``, ``SKIP``,
``LIMIT`` and ``UNION [ALL]`` with patterns of any length, alternatives of labels and types, inline properties, both
directions and bounded variable lengths. A pattern becomes a chain of joins over scans with their own filters, an optional
one a left join on the variables it shares, grouping follows the items without an aggregate; Catalyst orders and prunes the
rest. Walks may repeat nodes and edges. Patterns that share no variable with what is bound are refused, as they would be
a cross join. A variable's properties are columns of their own, so only those that are used are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.patterns import of_label, of_type, oriented

_TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|<=|>=|=~|<-|->|\.\.|[-+*/%=<>()\[\]{},.:|$])""")
_PROPS = {"node": ("id", "label", "name", "filePath", "language", "isExported", "repo"), "edge": ("type", "confidence", "step")}
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "UNWIND", "CALL", "RETURN", "ORDER", "SKIP", "LIMIT", "UNION", "YIELD"}
_AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": lambda c: F.array_sort(F.collect_list(c))}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "coalesce": F.coalesce, "abs": F.abs, "round": lambda c, n=None: F.round(c, 0 if n is None else n), "trim": F.trim,
    "size": lambda c: F.size(c), "length": lambda c: F.size(c) - 1, "char_length": F.length, "split": lambda c, s: F.split(c, s), "substring": lambda c, a, n: F.substring(c, a + 1, n), "reverse": F.reverse,
    "greatest": F.greatest, "least": F.least, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "tofloat": lambda c: c.cast("double"), "concat": F.concat,
}


class QueryError(ValueError):
    """The statement isn't one of the language, or names what isn't there."""


@dataclass
class Node:
    var: str
    labels: list[str]
    props: dict[str, Any]


@dataclass
class Rel:
    var: str | None
    types: list[str]
    direction: str
    least: int = 1
    most: int = 1
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class Pattern:
    path: str | None
    nodes: list[Node]
    rels: list[Rel]


class _Reader:
    """Tokens of a statement, and its clauses by recursive descent; expressions are trees of tuples."""

    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m.group()))
            at = m.end()
        self.i, self.made = 0, 0

    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if self.i + k < len(self.toks) else ""

    def kind(self) -> str:
        return self.toks[self.i][0] if self.i < len(self.toks) else ""

    def word(self, *words: str) -> bool:
        """Takes the keywords if they come next."""
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def take(self, op: str) -> bool:
        if self.kind() == "op" and self.peek() == op:
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise QueryError(f"expected {op!r} before {self.peek()!r}")

    def name(self) -> str:
        if self.kind() != "name":
            raise QueryError(f"expected a name, got {self.peek()!r}")
        self.i += 1
        return self.toks[self.i - 1][1].strip("`")

    # -- patterns
    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.kind() == "name" else None
        labels = self.alternatives() if self.take(":") else []
        props = self.map() if self.peek() == "{" else {}
        self.need(")")
        if var is None:
            self.made += 1
            var = f"_n{self.made}"
        return Node(var, labels, props)

    def alternatives(self) -> list[str]:
        out = [self.name()]
        while self.take("|"):
            self.take(":")
            out.append(self.name())
        return out

    def map(self) -> dict[str, Any]:
        self.need("{")
        out = {}
        while not self.take("}"):
            k = self.name()
            self.need(":")
            out[k] = self.expr()
            self.take(",")
        return out

    def rel(self) -> Rel:
        back = self.take("<-")
        if not back:
            self.need("-")
        r = Rel(None, [], "both")
        if self.take("["):
            if self.kind() == "name":
                r.var = self.name()
            if self.take(":"):
                r.types = self.alternatives()
            if self.take("*"):
                r.least = int(self.number()) if self.kind() == "num" else 1
                r.most = r.least if self.toks[self.i - 1][0] == "num" else 0
                if self.take(".."):
                    r.most = int(self.number()) if self.kind() == "num" else 0
                if r.most < r.least or r.most == 0:
                    raise QueryError("a variable length needs an upper bound")
            if self.peek() == "{":
                r.props = self.map()
            self.need("]")
        forward = self.take("->")
        if not forward:
            self.need("-")
        r.direction = "both" if back == forward else "in" if back else "out"
        return r

    def number(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def pattern(self) -> Pattern:
        path = None
        if self.kind() == "name" and self.peek(1) == "=":
            path = self.name()
            self.need("=")
        p = Pattern(path, [self.node()], [])
        while self.peek() in ("-", "<-"):
            p.rels.append(self.rel())
            p.nodes.append(self.node())
        return p

    # -- expressions
    def expr(self, least: int = 0):
        if self.word("NOT"):
            left = ("not", self.expr(3))
        else:
            left = self.unary()
        while True:
            op = self.peek().upper()
            if op == "OR" and least <= 1:
                self.i += 1
                left = ("or", left, self.expr(2))
            elif op == "AND" and least <= 2:
                self.i += 1
                left = ("and", left, self.expr(3))
            elif op in ("=", "<>", "<", "<=", ">", ">=", "=~") and self.kind() == "op" and least <= 4:
                self.i += 1
                left = (op, left, self.expr(5))
            elif op in ("IN", "CONTAINS") and least <= 4:
                self.i += 1
                left = (op.lower(), left, self.expr(5))
            elif op in ("STARTS", "ENDS") and least <= 4:
                self.i += 1
                if not self.word("WITH"):
                    raise QueryError("expected WITH")
                left = (op.lower(), left, self.expr(5))
            elif op == "IS" and least <= 4:
                self.i += 1
                left = ("notnull", left) if self.word("NOT", "NULL") else ("null", left) if self.word("NULL") else self.fail()
            elif op in ("+", "-") and least <= 5:
                self.i += 1
                left = (op, left, self.expr(6))
            elif op in ("*", "/", "%") and least <= 6:
                self.i += 1
                left = (op, left, self.expr(7))
            else:
                return left

    def fail(self):
        raise QueryError(f"unexpected {self.peek()!r}")

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        e = self.primary()
        while True:
            if self.take("."):
                e = ("prop", e, self.name())
            elif self.take("["):
                if self.take(".."):
                    e = ("slice", e, ("lit", 0), self.expr())
                else:
                    i = self.expr()
                    e = ("slice", e, i, self.expr()) if self.take("..") else ("at", e, i)
                self.need("]")
            else:
                return e

    def primary(self):
        kind, text = self.kind(), self.peek()
        if kind == "num":
            self.i += 1
            return ("lit", float(text) if "." in text else int(text))
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1]))
        if self.take("$"):
            return ("param", self.name())
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            if self.kind() == "name" and self.peek(1).upper() == "IN":
                var = self.name()
                self.i += 1
                over = self.expr()
                where = self.expr() if self.word("WHERE") else None
                out = self.expr() if self.take("|") else ("var", var)
                self.need("]")
                return ("each", var, over, where, out)
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if self.word("CASE"):
            whens = []
            while self.word("WHEN"):
                c = self.expr()
                if not self.word("THEN"):
                    self.fail()
                whens.append((c, self.expr()))
            other = self.expr() if self.word("ELSE") else ("lit", None)
            if not self.word("END"):
                self.fail()
            return ("case", whens, other)
        if kind == "name":
            name = self.name()
            if name.lower() in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[name.lower()])
            if self.take("("):
                distinct = self.word("DISTINCT")
                args = []
                if self.take("*"):
                    args.append(("star",))
                while not self.take(")"):
                    args.append(self.expr())
                    self.take(",")
                return ("call", name.lower(), distinct, args)
            return ("var", name)
        return self.fail()

    def items(self) -> list[tuple[Any, str]]:
        out = []
        while True:
            if self.take("*"):
                out.append((("star",), "*"))
            else:
                at = self.i
                e = self.expr()
                text = "".join(t for _, t in self.toks[at : self.i])
                out.append((e, self.name() if self.word("AS") else text))
            if not self.take(","):
                return out


def _aggregated(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and (e[1] in _AGGREGATES or e[1] == "count"):
        return True
    return isinstance(e, (tuple, list)) and any(map(_aggregated, e))


class Graph:
    """Nodes (id, label, name, filePath, language, isExported, repo) and edges (id, src, dst, type, confidence, step) to
    be asked; ``procedures`` are tables that a CALL gives, by name."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, procedures: dict[str, Callable[..., DataFrame]] | None = None):
        self.spark, self.nodes, self.edges, self.procedures = spark, nodes, edges, procedures or {}

    def query(self, text: str, **params: Any) -> DataFrame:
        """The result of a statement; ``$name`` stands for a parameter, which is a value and never part of the text."""
        r = _Reader(text)
        out = _Part(self, r, params).run()
        while r.word("UNION"):
            every = r.word("ALL")
            out = out.union(_Part(self, r, params).run())
            if not every:
                out = out.distinct()
        if r.kind():
            raise QueryError(f"unexpected {r.peek()!r}")
        return out


class _Part:
    """One statement between UNIONs: rows so far, and what each variable is: node, edge, path or value."""

    def __init__(self, graph: Graph, r: _Reader, params: dict[str, Any]):
        self.g, self.r, self.params = graph, r, params
        self.rows: DataFrame | None = None
        self.scope: dict[str, str] = {}

    def run(self) -> DataFrame:
        r = self.r
        while True:
            if r.word("MATCH"):
                self.match()
            elif r.word("OPTIONAL", "MATCH"):
                self.optional()
            elif r.word("UNWIND"):
                e = r.expr()
                if not r.word("AS"):
                    r.fail()
                rows = self.g.spark.range(1).select() if self.rows is None else self.rows
                var = r.name()
                c = self.column(e)
                self.rows, self.scope = rows.withColumn(var, F.explode(c)), self.scope | {var: "value"}
            elif r.word("CALL"):
                self.call()
            elif r.word("WITH"):
                self.project(False)
                if r.word("WHERE"):
                    self.rows = self.rows.where(self.column(r.expr()))
            elif r.word("RETURN"):
                return self.project(True)
            else:
                raise QueryError(f"unexpected {r.peek()!r}" if r.kind() else "a statement ends with RETURN")

    # -- variables
    def columns(self, var: str) -> list[str]:
        kind = self.scope[var]
        return [f"{var}__{p}" for p in _PROPS[kind]] if kind in _PROPS else [var]

    def scan(self, n: Node) -> DataFrame:
        df = of_label(self.g.nodes, n.labels or None)
        for k, v in n.props.items():
            if not (v[0] == "var" and self.scope.get(v[1]) == "value"):
                df = df.where(F.col(k) == self.column(v))
        return df.select(*[F.col(p).alias(f"{n.var}__{p}") for p in _PROPS["node"]])

    def bind(self, n: Node) -> None:
        """The first node of a pattern."""
        if n.var in self.scope:
            if n.labels:
                self.rows = self.rows.where(F.col(f"{n.var}__label").isin(*n.labels))
            for k, v in n.props.items():
                self.rows = self.rows.where(F.col(f"{n.var}__{k}") == self.column(v))
            return
        joins = [(k, v[1]) for k, v in n.props.items() if v[0] == "var" and self.scope.get(v[1]) == "value"]
        side = self.scan(n)
        if self.rows is None:
            self.rows = side
        elif joins:
            cond = None
            for k, v in joins:
                c = F.col(f"{n.var}__{k}") == F.col(v)
                cond = c if cond is None else cond & c
            self.rows = self.rows.join(side, cond)
        else:
            raise QueryError(f"the pattern of {n.var} shares no variable with what is bound")
        self.scope[n.var] = "node"

    def patterns(self) -> list[Pattern]:
        out = [self.r.pattern()]
        while self.r.take(","):
            out.append(self.r.pattern())
        return out

    def match(self) -> None:
        waiting = self.patterns()
        while waiting:
            k = next((i for i, p in enumerate(waiting) if any(n.var in self.scope for n in p.nodes)), 0)
            self.chain(waiting.pop(k))
        if self.r.word("WHERE"):
            self.rows = self.rows.where(self.column(self.r.expr()))

    def chain(self, p: Pattern) -> None:
        at = next((i for i, n in enumerate(p.nodes) if n.var in self.scope), 0)
        self.bind(p.nodes[at])
        if p.path:
            if at:
                raise QueryError("a named path starts at its first bound node")
            self.rows = self.rows.withColumn(p.path, F.array(self.step(p.nodes[0].var)))
        for i in range(at, len(p.rels)):
            self.hop(p.nodes[i], p.rels[i], p.nodes[i + 1], p.rels[i].direction, p.path)
        for i in range(at - 1, -1, -1):
            self.hop(p.nodes[i + 1], p.rels[i], p.nodes[i], {"out": "in", "in": "out", "both": "both"}[p.rels[i].direction], None)
        if p.path:
            self.scope[p.path] = "path"

    def step(self, var: str) -> Column:
        return F.struct(*[F.col(f"{var}__{p}").alias(p) for p in ("id", "label", "name", "filePath")])

    def hop(self, here: Node, rel: Rel, there: Node, direction: str, path: str | None) -> None:
        out, scope = None, dict(self.scope)
        e = oriented(of_type(self.g.edges, rel.types or None), direction)
        for k, v in rel.props.items():
            e = e.where(F.col(k) == self.column(v))
        long = (rel.least, rel.most) != (1, 1)
        rows = self.rows.withColumn("__at", F.col(f"{here.var}__id"))
        for d in range(1, rel.most + 1):
            side = e.select(F.col("here").alias("__at"), F.col("there").alias("__to"), *[F.col(p).alias(f"__{p}") for p in _PROPS["edge"]])
            rows = rows.join(side, "__at").drop("__at")
            last = Node(there.var, there.labels, there.props) if d >= rel.least else None
            reached = None
            if last is not None:
                new = rows
                if there.var in scope:
                    new = new.where(F.col("__to") == F.col(f"{there.var}__id"))
                    if there.labels:
                        new = new.where(F.col(f"{there.var}__label").isin(*there.labels))
                else:
                    nodes = self.scan(there)
                    new = new.join(nodes, F.col("__to") == F.col(f"{there.var}__id"))
                if path:
                    new = new.withColumn(path, F.concat(path, F.array(self.step(there.var))))
                reached = new.drop("__to")
                keep = [c for c in reached.columns if not (c.startswith("__") and c[2:] in _PROPS["edge"])]
                if rel.var and not long:
                    reached = reached.select(*keep, *[F.col(f"__{p}").alias(f"{rel.var}__{p}") for p in _PROPS["edge"]])
                else:
                    reached = reached.select(*keep)
                out = reached if out is None else out.unionByName(reached)
            if d < rel.most:
                if path:
                    mid = self.g.nodes.select(F.col("id").alias("__to"), F.struct("id", "label", "name", "filePath").alias("__mid"))
                    rows = rows.join(mid, "__to").withColumn(path, F.concat(path, F.array("__mid"))).drop("__mid")
                rows = rows.withColumnRenamed("__to", "__at").drop(*[f"__{p}" for p in _PROPS["edge"]])
        self.rows = out
        self.scope[there.var] = "node"
        if rel.var:
            if long:
                raise QueryError("a relationship of variable length has no properties; name the path")
            self.scope[rel.var] = "edge"

    def optional(self) -> None:
        if self.rows is None:
            raise QueryError("OPTIONAL MATCH needs what it adds to")
        before = dict(self.scope)
        kept = self.rows
        patterns = self.patterns()
        shared = [v for v in before if before[v] == "node" and any(n.var == v for p in patterns for n in p.nodes)]
        if not shared:
            raise QueryError("an optional pattern shares no variable with what is bound")
        self.scope = {v: "node" for v in shared}
        self.rows = kept.select(*[c for v in shared for c in self.columns(v)]).distinct()
        for p in patterns:
            self.chain(p)
        if self.r.word("WHERE"):
            self.rows = self.rows.where(self.column(self.r.expr()))
        new = [v for v in self.scope if v not in before]
        found = self.rows.select(*[F.col(f"{v}__id").alias(f"__{v}") for v in shared], *[c for v in new for c in self.columns(v)])
        cond = None
        for v in shared:
            c = F.col(f"{v}__id") == F.col(f"__{v}")
            cond = c if cond is None else cond & c
        self.rows = kept.join(found, cond, "left").drop(*[f"__{v}" for v in shared])
        self.scope = before | {v: self.scope[v] for v in new}

    def call(self) -> None:
        name = self.r.name()
        if name not in self.g.procedures:
            raise QueryError(f"no procedure {name!r}")
        if self.rows is not None:
            raise QueryError("CALL begins a statement")
        self.r.need("(")
        args = []
        while not self.r.take(")"):
            args.append(self.value(self.r.expr()))
            self.r.take(",")
        df = self.g.procedures[name](*args)
        if self.r.word("YIELD"):
            names = [self.r.name()]
            while self.r.take(","):
                names.append(self.r.name())
            df = df.select(*names)
        self.rows, self.scope = df, {c: "value" for c in df.columns}

    def value(self, e):
        """A literal or parameter as a value of Python."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.parameter(e[1])
        if e[0] == "neg":
            return -self.value(e[1])
        if e[0] == "list":
            return [self.value(x) for x in e[1]]
        raise QueryError("a procedure takes literals and parameters")

    def parameter(self, name: str):
        if name not in self.params:
            raise QueryError(f"no parameter {name!r}")
        return self.params[name]

    # -- expressions
    def column(self, e, local: dict[str, Column] | None = None) -> Column:
        kind, rest = e[0], e[1:]
        col = lambda x: self.column(x, local)
        if kind in ("lit", "param"):
            v = e[1] if kind == "lit" else self.parameter(e[1])
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if kind == "list":
            return F.array(*map(col, rest[0]))
        if kind == "var":
            return self.variable(rest[0], local)
        if kind == "prop":
            return self.property(rest[0], rest[1], local)
        if kind == "call":
            return self.function(*rest, local=local)
        if kind == "case":
            out = None
            for c, v in rest[0]:
                out = F.when(col(c), col(v)) if out is None else out.when(col(c), col(v))
            return out.otherwise(col(rest[1]))
        if kind == "each":
            var, over, where, result = rest
            a = col(over)
            if where is not None:
                a = F.filter(a, lambda x: self.column(where, (local or {}) | {var: x}))
            return F.transform(a, lambda x: self.column(result, (local or {}) | {var: x}))
        if kind == "at":
            return F.get(col(rest[0]), col(rest[1]))
        if kind == "slice":
            a, b = col(rest[1]), col(rest[2])
            return F.slice(col(rest[0]), a + 1, b - a)
        if kind == "in" and rest[1][0] in ("list", "param", "lit"):
            v = rest[1]
            return col(rest[0]).isin([self.value(x) for x in v[1]] if v[0] == "list" else list(self.value(v)))
        if kind in ("not", "neg", "null", "notnull"):
            a = col(rest[0])
            return {"not": lambda: ~a, "neg": lambda: -a, "null": a.isNull, "notnull": a.isNotNull}[kind]()
        a, b = col(rest[0]), col(rest[1])
        return {
            "or": lambda: a | b, "and": lambda: a & b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "contains": lambda: a.contains(b), "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b),
            "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "in": lambda: F.array_contains(b, a),
        }[kind]()

    def variable(self, var: str, local: dict[str, Column] | None) -> Column:
        if local and var in local:
            return local[var]
        kind = self.scope.get(var)
        if kind is None:
            raise QueryError(f"no variable {var!r}")
        return F.struct(*[F.col(c).alias(c.split("__")[1]) for c in self.columns(var)]) if kind in _PROPS else F.col(f"`{var}`")

    def property(self, of, name: str, local: dict[str, Column] | None) -> Column:
        if of[0] == "var" and not (local and of[1] in local) and self.scope.get(of[1]) in _PROPS:
            if name not in _PROPS[self.scope[of[1]]]:
                raise QueryError(f"no property {name!r}")
            return F.col(f"{of[1]}__{name}")
        return self.column(of, local)[name]

    def function(self, name: str, distinct: bool, args: list, local=None) -> Column:
        if name == "count":
            if args == [("star",)]:
                return F.count("*")
            a = args[0]
            c = F.col(f"{a[1]}__{'id' if self.scope[a[1]] == 'node' else 'type'}") if a[0] == "var" and self.scope.get(a[1]) in _PROPS else self.column(a, local)
            return F.count_distinct(c) if distinct else F.count(c)
        if name in _AGGREGATES:
            c = self.column(args[0], local)
            if distinct and name == "collect":
                return F.array_sort(F.collect_set(c))
            return F.sum_distinct(c) if distinct and name == "sum" else _AGGREGATES[name](c)
        if name in ("id", "label", "labels", "type") and args[0][0] == "var" and self.scope.get(args[0][1]) in _PROPS:
            return F.col(f"{args[0][1]}__{'label' if name == 'labels' else name}")
        if name == "nodes":
            return self.column(args[0], local)
        if name == "join":
            return F.array_join(self.column(args[0], local), str(self.value(args[1])))
        if name not in _FUNCTIONS:
            raise QueryError(f"no function {name!r}")
        return _FUNCTIONS[name](*[self.column(a, local) for a in args])

    # -- WITH and RETURN
    def project(self, last: bool) -> DataFrame:
        r = self.r
        distinct = r.word("DISTINCT")
        items = []
        for e, name in r.items():
            items.extend([(("var", v), v) for v in self.scope] if e == ("star",) else [(e, name)])
        order = []
        if r.word("ORDER", "BY"):
            while True:
                e = r.expr()
                down = bool(r.word("DESC") or r.word("DESCENDING"))
                if not down and not r.word("ASC"):
                    r.word("ASCENDING")
                order.append((e, down))
                if not r.take(","):
                    break
        skip = self.value(r.expr()) if r.word("SKIP") else None
        limit = self.value(r.expr()) if r.word("LIMIT") else None
        names = {n: e for e, n in items}
        scope: dict[str, str] = {}
        plain: list[Column] = []
        totals: list[Column] = []
        for e, n in items:
            if e[0] == "var" and self.scope.get(e[1]) in _PROPS and not last:
                scope[n] = self.scope[e[1]]
                plain += [F.col(c).alias(f"{n}__{c.split('__')[1]}") for c in self.columns(e[1])]
            else:
                scope[n] = "value" if not (e[0] == "var" and self.scope.get(e[1]) == "path") else "path"
                (totals if _aggregated(e) else plain).append(self.column(e).alias(n))
        # what is sorted by is an item, or a column beside the items
        keys = []
        for k, (e, down) in enumerate(order):
            same = next((n for n, x in names.items() if x == e or e == ("var", n)), None)
            if same is not None and scope[same] == "value":
                keys.append((f"`{same}`", down))
            elif _aggregated(e):
                totals.append(self.column(e).alias(f"__o{k}"))
                keys.append((f"__o{k}", down))
            elif totals or distinct:
                raise QueryError("what is sorted by must be one of the items")
            else:
                plain.append(self.column(e).alias(f"__o{k}"))
                keys.append((f"__o{k}", down))
        rows = self.rows if self.rows is not None else self.g.spark.range(1).select()
        rows = (rows.groupBy(*plain).agg(*totals) if plain else rows.agg(*totals)) if totals else rows.select(*plain)
        if distinct:
            rows = rows.distinct()
        if keys:
            rows = rows.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in keys])
        if skip:
            rows = rows.offset(int(skip))
        if limit is not None:
            rows = rows.limit(int(limit))
        if last:
            return rows.select(*[F.col(f"`{n}`") for _, n in items])
        self.rows, self.scope = rows.drop(*[c for c in rows.columns if c.startswith("__o")]), scope
        return self.rows
