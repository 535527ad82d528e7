"""SPARQL SELECT over quads: a parser and a compiler to DataFrame operations.

Solutions are frames with one string column of term keys per variable, null where unbound. Patterns become equi-joins of
predicate-filtered scans, OPTIONAL left joins with its filters inside, MINUS and EXISTS anti- and semi-joins, property
paths joins, unions and frontier loops. Errors in expressions are nulls, which filters drop.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import bounds, terms
from graphloom.operators import relations, traversal
from graphloom.sources.files import BUCKET, of_predicates

XSD, RDF_TYPE = "http://www.w3.org/2001/XMLSchema#", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<var>[?$]\w+)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<pname>[A-Za-z][\w.-]*:[\w.%-]*|:[\w.%-]+)|(?P<word>[A-Za-z_]\w*)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/^|?])""",
    re.X | re.S,
)


def tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query at {query[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


@dataclass
class Group:
    """Elements of a group pattern in order: (kind, …)."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Select:
    items: list[tuple[str, object]] | None  # (name, expression or None); None: all
    where: Group
    distinct: bool = False
    groups: list[tuple[str, object]] = field(default_factory=list)
    grouped: bool = False
    having: list[object] = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    values: tuple | None = None


class Parser:
    def __init__(self, query: str):
        self.toks, self.at, self.prefixes, self.fresh = tokens(query), 0, {}, 0
        self.base = ""

    # helpers
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.toks[self.at - 1] if self.at <= len(self.toks) else ("end", "")

    def word(self, *names: str) -> bool:
        kind, text = self.peek()
        if kind == "word" and text.upper() in names:
            self.at += 1
            return True
        return False

    def is_word(self, *names: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in names

    def op(self, text: str) -> bool:
        if self.peek() == ("op", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise ValueError(f"expected {text!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        self.fresh += 1
        return f"__{self.fresh}"

    # query
    def query(self) -> Select:
        while self.is_word("PREFIX", "BASE"):
            if self.word("BASE"):
                self.base = self.next()[1][1:-1]
                continue
            self.word("PREFIX")
            p = self.next()[1]
            self.prefixes[p.rstrip(":") if p.endswith(":") else p[: p.index(":")]] = self.next()[1][1:-1]
        if not self.is_word("SELECT"):
            raise ValueError("only SELECT queries are supported")
        q = self.select()
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return q

    def select(self) -> Select:
        self.word("SELECT")
        distinct = self.word("DISTINCT", "REDUCED")
        items: list | None = []
        if self.op("*"):
            items = None
        else:
            while self.peek()[0] == "var" or self.peek() == ("op", "("):
                if self.op("("):
                    e = self.expression()
                    if not self.word("AS"):
                        raise ValueError("AS expected")
                    items.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    items.append((self.next()[1][1:], None))
        while self.word("FROM"):
            raise ValueError("there is one default graph")
        self.word("WHERE")
        q = Select(items, self.group(), distinct)
        if self.word("GROUP"):
            self.word("BY")
            q.grouped = True
            while self.peek()[0] == "var" or self.peek() == ("op", "(") or (self.peek()[0] == "word" and self.peek(1) == ("op", "(") and not self.is_word("HAVING")):
                if self.peek()[0] == "var":
                    n = self.next()[1][1:]
                    q.groups.append((n, ("var", n)))
                elif self.op("("):
                    e = self.expression()
                    n = self.next()[1][1:] if self.word("AS") else self.name()
                    self.need(")")
                    q.groups.append((n, e))
                else:
                    q.groups.append((self.name(), self.primary()))
        if self.word("HAVING"):
            while self.peek() == ("op", "("):
                self.need("(")
                q.having.append(self.expression())
                self.need(")")
        if self.word("ORDER"):
            self.word("BY")
            while self.peek()[0] == "var" or self.peek() == ("op", "(") or (self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                q.order.append((self.primary(), down))
        while self.is_word("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                q.limit = int(self.next()[1])
            else:
                self.word("OFFSET")
                q.offset = int(self.next()[1])
        if self.word("VALUES"):
            q.values = self.inline()
        return q

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.is_word("SELECT"):
            g.parts.append(("select", self.select()))
        while not self.op("}"):
            if self.word("FILTER"):
                if self.is_word("EXISTS", "NOT"):
                    negative = self.word("NOT")
                    self.word("EXISTS")
                    g.parts.append(("exists", self.group(), negative))
                else:
                    g.parts.append(("filter", self.primary()))
            elif self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.word("AS")
                g.parts.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.word("VALUES"):
                g.parts.append(("values", *self.inline()))
            elif self.word("GRAPH", "SERVICE"):
                raise ValueError("there is one default graph and no service")
            elif self.peek() == ("op", "{"):
                arms = [self.group()]
                while self.word("UNION"):
                    arms.append(self.group())
                g.parts.append(("union", arms) if len(arms) > 1 else ("group", arms[0]))
            elif self.op("."):
                pass
            else:
                self.triples(g)
        return g

    def inline(self) -> tuple[list[str], list[list[str | None]]]:
        if self.op("("):
            names = []
            while not self.op(")"):
                names.append(self.next()[1][1:])
        else:
            names = [self.next()[1][1:]]
            self.need("{")
            rows = []
            while not self.op("}"):
                rows.append([None if self.word("UNDEF") else self.term()[1]])
            return names, rows
        self.need("{")
        rows = []
        while not self.op("}"):
            self.need("(")
            row = []
            while not self.op(")"):
                row.append(None if self.word("UNDEF") else self.term()[1])
            rows.append(row)
        return names, rows

    def triples(self, g: Group) -> None:
        s = self.node(g)
        while True:
            p = self.path()
            while True:
                g.parts.append(("triple", s, p, self.node(g)))
                if not self.op(","):
                    break
            if not self.op(";"):
                break
            if self.peek() in (("op", "."), ("op", "}")):
                break

    def node(self, g: Group) -> tuple[str, str]:
        if self.op("["):
            n = ("var", self.name())
            while not self.op("]"):
                p = self.path()
                g.parts.append(("triple", n, p, self.node(g)))
                self.op(";")
            return n
        return self.term()

    def term(self) -> tuple[str, str]:
        """("var", name) or ("const", key)."""
        kind, text = self.next()
        if kind == "var":
            return "var", text[1:]
        if kind == "iri":
            return "const", text if ":" in text else f"<{self.base}{text[1:-1]}>"
        if kind == "pname":
            p, _, local = text.partition(":")
            if p not in self.prefixes:
                raise ValueError(f"unknown prefix {p!r}")
            while local.endswith("."):
                local = local[:-1]
                self.toks.insert(self.at, ("op", "."))
            return "const", f"<{self.prefixes[p]}{local}>"
        if kind == "string":
            body = text[3:-3] if text.startswith('"""') else text[1:-1]
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            if self.op("^^"):
                t = self.term()[1][1:-1]
                name = t.rsplit("#", 1)[-1].rsplit("/", 1)[-1]
                if name in ("integer", "long", "int", "short", "byte"):
                    return "const", f"{int(body)}^^Long"
                if name in ("double", "float", "decimal"):
                    return "const", f"{_double(float(body))}^^Double"
                if name in ("dateTime", "date"):
                    return "const", f"{body}^^Temporal"
                if name in terms.TYPES:
                    return "const", f"{body}^^{name}"
            elif self.peek()[0] == "lang":
                self.next()
            return "const", f"{body}^^String"
        if kind == "number" or (kind == "op" and text in "+-"):
            sign = ""
            if kind == "op":
                sign, text = ("-" if text == "-" else ""), self.next()[1]
            return "const", f"{sign}{int(text)}^^Long" if re.fullmatch(r"\d+", text) else f"{_double(float(sign + text))}^^Double"
        if kind == "word" and text in ("true", "false"):
            return "const", f"{text}^^String"
        if kind == "word" and text == "a":
            return "const", RDF_TYPE
        raise ValueError(f"term expected, found {text!r}")

    # property paths
    def path(self):
        if self.peek()[0] == "var":
            return "var", self.next()[1][1:]
        return self.path_alt()

    def path_alt(self):
        arms = [self.path_seq()]
        while self.op("|"):
            arms.append(self.path_seq())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def path_seq(self):
        steps = [self.path_unit()]
        while self.op("/"):
            steps.append(self.path_unit())
        return steps[0] if len(steps) == 1 else ("seq", steps)

    def path_unit(self):
        if self.op("^"):
            return "inv", self.path_unit()
        if self.op("!"):
            names = []
            if self.op("("):
                while not self.op(")"):
                    names.append(self.term()[1])
                    self.op("|")
            else:
                names.append(self.term()[1])
            e = ("not", names)
        elif self.op("("):
            e = self.path_alt()
            self.need(")")
        else:
            e = self.term()
        for m in "*+?":
            if self.op(m):
                return m, e
        return e

    # expressions
    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        for o in ("!=", "<=", ">=", "=", "<", ">"):
            if self.op(o):
                return "cmp", o, e, self.sum()
        negative = self.is_word("NOT") and self.peek(1)[1].upper() == "IN" and self.word("NOT")
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                self.op(",")
            out = ("in", e, items)
            return ("not", out) if negative else out
        return e

    def sum(self):
        e = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            o = self.next()[1]
            e = ("arith", o, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.peek() in (("op", "*"), ("op", "/")):
            o = self.next()[1]
            e = ("arith", o, e, self.unary())
        return e

    def unary(self):
        if self.op("!"):
            return "not", self.unary()
        if self.op("-"):
            return "arith", "-", ("const", "0^^Long"), self.unary()
        self.op("+")
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.peek()
        if kind == "word" and text not in ("true", "false"):
            self.next()
            return self.call(text.upper())
        t = self.term()
        if t[0] == "const" and self.peek() == ("op", "(") and t[1].startswith("<"):
            return self.call(re.split(r"[#/]", t[1][1:-1])[-1].upper())
        return t

    def call(self, name: str):
        self.need("(")
        if name in ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"):
            distinct = self.word("DISTINCT")
            e = None if self.op("*") else self.expression()
            sep = " "
            if self.op(";"):
                self.word("SEPARATOR")
                self.need("=")
                sep = self.next()[1][1:-1]
            self.need(")")
            return "agg", name, e, distinct, sep
        args = []
        while not self.op(")"):
            args.append(self.expression())
            self.op(",")
        return "call", name, args


def _double(x: float) -> str:
    return repr(x)


# expression values: ("term", key[, constant key[, number, exact long]]) | ("num", value, is double[, exact long]) | ("str", text) | ("bool", test)
def _term(v) -> Column:
    if v[0] == "term":
        return v[1]
    if v[0] == "num":
        return F.when(v[2], terms.double(v[1])).otherwise(terms.long(F.coalesce(_long(v), v[1].cast("long"))))
    return terms.string(v[1])


def _num(v) -> Column:
    return v[1] if v[0] == "num" else v[3] if v[0] == "term" and len(v) > 3 else terms.number(v[1]) if v[0] == "term" else v[1].try_cast("double") if v[0] == "str" else F.lit(None).cast("double")


def _long(v) -> Column:
    """The exact value of a long; null of anything else."""
    return v[-1] if v[0] in ("num", "term") and len(v) > 3 else terms.whole(v[1]) if v[0] == "term" else F.lit(None).cast("long")


def _is_double(v) -> Column:
    return v[2] if v[0] == "num" else v[1].endswith("^^Double") if v[0] == "term" else F.lit(True)


def _str(v) -> Column:
    if v[0] == "term":
        return terms.lexical(v[1])
    return terms.lexical(_term(v)) if v[0] == "num" else v[1].cast("string")


def _bool(v) -> Column:
    """The effective boolean value."""
    if v[0] == "bool":
        return v[1]
    if v[0] == "num":
        return (v[1] != 0) & ~F.isnan(v[1])
    if v[0] == "str":
        return F.length(v[1]) > 0
    n = terms.number(v[1])
    text = terms.lexical(v[1])
    return F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(v[1].endswith("^^String"), (F.length(text) > 0) & (text != "false"))


#: Accessors and the predicate whose bounds they read of a node.
ACCESSORS = {"BOUNDS_AREA": "bounds", "BOUNDS_CENTER": "bounds", "SEGMENT_CENTER": "segmentBounds", "SEGMENT_AREA": "segmentDefinition", "WIDTH": "bounds", "HEIGHT": "bounds", "DEPTH": "bounds", "DURATION": "bounds", "XYZT": "bounds"}
#: Own functions by name in capitals: each takes expression values and gives one. CLIP_TEXT is one if an embedder is set.
FUNCTIONS: dict = {}


def register_function(name: str, make) -> None:
    """Adds a function of queries: make(*columns of texts) gives a column of texts."""
    FUNCTIONS[name.upper()] = lambda *v: ("str", make(*[_str(x) for x in v]))


def set_text_embedder(embed) -> None:
    """Makes CLIP_TEXT(text) give the comma-joined vector of embed(list of texts), called on Arrow batches; an empty text where
    it fails. Each batch asks for each of its distinct texts once."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        own = [t for t in dict.fromkeys(x) if t is not None]
        try:
            known = {t: ",".join(map(repr, map(float, v))) for t, v in zip(own, embed(own))}
        except Exception:  # noqa: BLE001 - a service that is down gives empty texts
            known = {}
        return x.map(lambda t: None if t is None else known.get(t, ""))

    register_function("CLIP_TEXT", run)


#: Columns with the number and the exact long of a variable, computed before a join that compares them pair by pair.
NUMBER, WHOLE = "__number_", "__whole_"


def _conjuncts(e) -> list:
    return [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "and" else [e]


def _names(e) -> set[str]:
    """The variables of an expression."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    return {n for x in e for n in _names(x)} if isinstance(e, (tuple, list)) else set()


def _linear(e, binds: dict) -> tuple[str | None, float, bool] | None:
    """An expression as a variable (or none) plus a constant, and whether it calculates; None if it is of another form."""
    if e[0] == "var":
        if e[1] in binds:
            return _linear(binds[e[1]], {n: x for n, x in binds.items() if n != e[1]})
        return e[1], 0.0, False
    if e[0] == "const" and e[1].endswith(("^^Long", "^^Double")):
        try:
            x = float(e[1].split("^^")[0])
        except ValueError:
            return None
        return (None, x, False) if math.isfinite(x) else None
    if e[0] == "arith" and e[1] in "+-":
        a, b = _linear(e[2], binds), _linear(e[3], binds)
        if a is None or b is None or b[0] is not None and (e[1] == "-" or a[0] is not None):
            return None
        return a[0] or b[0], a[1] + b[1] if e[1] == "+" else a[1] - b[1], True
    return None


class Compiler:
    def __init__(self, quads: DataFrame):
        self.quads = quads.select("s", "p", "o", *[c for c in quads.columns if c == BUCKET])

    # patterns: frame and the variables that may be unbound
    def group(self, g: Group) -> tuple[DataFrame, set[str]]:
        df, maybe = None, set()
        filters: list = []
        run: list = []
        # filters hold for the whole group; a run of triples between other patterns is joined most selective first
        parts = [*sorted(g.parts, key=lambda p: p[0] in ("filter", "exists")), ("end",)]
        tests = [e for p in parts if p[0] == "filter" for e in _conjuncts(p[1])]
        early: set[str] = set()
        for at, part in enumerate(parts):
            kind = part[0]
            if kind == "triple":
                run.append(part)
                continue
            if run:
                binds = dict(p[1:] for p in itertools.takewhile(lambda p: p[0] == "bind", parts[at:]))
                df, maybe, made = self.run(df, maybe, run, binds, tests)
                early |= made
            run = []
            if kind == "end":
                break
            if kind == "filter":
                filters.append(part[1])
            elif kind == "exists":
                filters.append(part)
            elif kind == "optional":
                df, maybe = self.optional(df, maybe, part[1])
            elif kind == "minus":
                df = self.minus(df, maybe, *self.group(part[1]))
            elif kind == "bind" and part[1] not in early:
                e, df = self.with_bounds(part[2], self.unit() if df is None else df)
                df = df.withColumn(part[1], _term(self.value(e, df)))
                maybe = maybe | {part[1]}
            elif kind == "values":
                df, maybe = self.join(df, maybe, *self.inline(part[1], part[2]))
            elif kind == "group":
                df, maybe = self.join(df, maybe, *self.group(part[1]))
            elif kind == "select":
                df, maybe = self.join(df, maybe, *self.select(part[1]))
            elif kind == "union":
                arms = [self.group(a) for a in part[1]]
                names = list(dict.fromkeys(c for a, _ in arms for c in a.columns))
                unbound = {c for a, m in arms for c in names if c in m or c not in a.columns}
                both = arms[0][0]
                for a, _ in arms[1:]:
                    both = both.unionByName(a, allowMissingColumns=True)
                df, maybe = self.join(df, maybe, both, unbound)
        df = self.unit() if df is None else df
        for f in filters:
            if f[0] == "exists":
                df = self.exists(df, maybe, f[1], f[2])
                continue
            f, df = self.with_bounds(f, df)
            df = df.where(F.coalesce(_bool(self.value(f, df)), F.lit(False)))
        return df.drop(*[c for c in df.columns if c.startswith((NUMBER, WHOLE, *(f"__{b}_" for b in set(ACCESSORS.values()))))]), maybe

    def run(self, df, maybe: set[str], run: list, binds: dict, tests: list) -> tuple[DataFrame, set[str], set[str]]:
        """A run of triples joined to the frame, most selective first. Where all facts of another subject meet the frame and
        the filters keep a number of theirs within a window around one of the frame, only pairs of near numbers meet. Also
        gives the variables of the binds that were computed for it."""
        rest, early = self.ordered(run, set(df.columns) if df is not None else set()), set()
        while rest:
            t = rest.pop(0)
            if df is not None and t[1][0] == "var" and t[1][1] not in df.columns:
                star = [t, *[x for x in rest if x[1] == t[1]]]
                own = {x[1] for p in star for x in p[1:] if x[0] == "var"}
                window = self.window(set(df.columns), own, maybe, binds, tests)
                if window is not None:
                    right = None
                    for x in star:
                        right, _ = self.join(right, set(), self.pattern(*x[1:]), set())
                    for n, e in binds.items():
                        if n not in df.columns and n not in own and _names(e) <= set(df.columns) - maybe and _linear(e, {}) is not None:
                            df, maybe, early = df.withColumn(n, _term(self.value(e, df))), maybe | {n}, early | {n}
                    df, rest = self.near(df, right, *window, tests), [x for x in rest if x not in star]
                    continue
            df, maybe = self.join(df, maybe, self.pattern(*t[1:]), set())
        return df, maybe, early

    @staticmethod
    def window(left: set[str], right: set[str], maybe: set[str], binds: dict, tests: list) -> tuple[str, str, float, float] | None:
        """Variables y of the right and z of the left and numbers a, b, if the filters hold only for numbers y from z + a to z + b."""
        if left & right & maybe:
            return None
        ends: dict[tuple[str, str], list] = {}
        for e in tests:
            if e[0] != "cmp" or e[1] not in ("<", "<=", ">", ">="):
                continue
            a, b, upper = _linear(e[2], binds), _linear(e[3], binds), e[1][0] == "<"
            if a is None or b is None:
                continue
            if a[0] not in right - left:
                a, b, upper = b, a, not upper
            if a[0] in right - left and b[0] in left - right - maybe:
                ends.setdefault((a[0], b[0]), []).append((upper, b[1] - a[1], a[2] or b[2]))
        for (y, z), found in ends.items():
            low, high = [x for up, x, _ in found if not up], [x for up, x, _ in found if up]
            # calculating is what makes a comparison one of numbers, as texts are compared too
            if low and high and any(c for *_, c in found):
                return y, z, max(low), min(high)
        return None

    def near(self, left: DataFrame, right: DataFrame, y: str, z: str, low: float, high: float, tests: list) -> DataFrame:
        """The join of frames on what they share, of pairs whose number y may lie from z + low to z + high (the filters decide):
        numbers fall into bins as wide as the window, and the left looks into the two or three bins that it reaches."""
        wide = high - low if high > low else 1.0
        most = F.lit(wide * 2.0**40)  # beyond it one bin takes all
        bin_of = lambda x: F.floor(F.greatest(F.least(x, most), -most) / F.lit(wide))
        wanted = {n for e in tests if e[0] == "cmp" for n in _names(e)} | {y, z}

        def numbered(df: DataFrame) -> DataFrame:
            # texts are read once for each row, not once for each pair
            for n in [c for c in df.columns if c in wanted and NUMBER + c not in df.columns]:
                df = df.withColumn(NUMBER + n, terms.number(F.col(f"`{n}`"))).withColumn(WHOLE + n, terms.whole(F.col(f"`{n}`")))
            return df

        shared = [n for n in left.columns if n in right.columns and not n.startswith("__")]
        at = F.col(f"`{NUMBER}{z}`")
        slack = (F.least(F.abs(at), most) + F.lit(abs(low) + abs(high))) * 1e-14
        left, right = numbered(left).where(at.isNotNull()), numbered(right).where(F.col(f"`{NUMBER}{y}`").isNotNull())
        left = left.withColumn("__bin", F.explode(F.sequence(bin_of(at + low - slack), bin_of(at + high + slack)))) if high >= low else left.withColumn("__bin", F.lit(0).cast("long")).limit(0)
        right = right.withColumn("__bin", bin_of(F.col(f"`{NUMBER}{y}`"))).drop(*[c for n in shared for c in (NUMBER + n, WHOLE + n)])
        return relations.together(left, right, [*shared, "__bin"]).drop("__bin")

    def unit(self) -> DataFrame:
        return self.quads.sparkSession.range(1).select()

    @staticmethod
    def ordered(triples: list, bound: set[str]) -> list:
        out, rest, bound = [], list(triples), set(bound)
        while rest:

            def rank(t):
                names = {x[1] for x in (t[1], t[2], t[3]) if x[0] == "var"}
                fixed = sum(w for x, w in ((t[1], 4), (t[3], 3), (t[2], 1)) if x[0] == "const")
                return (bool(out or bound) and not names & bound, -fixed, len(names - bound))

            t = min(rest, key=rank)
            rest.remove(t)
            out.append(t)
            bound |= {x[1] for x in (t[1], t[2], t[3]) if x[0] == "var"}
        return out

    def pattern(self, s, p, o) -> DataFrame:
        if p[0] == "var":
            df, names = self.quads.select("s", "p", "o"), {"s": s, "p": p, "o": o}
        else:
            df, names = self.edges(p, s, o), {"s": s, "o": o}
        seen: dict[str, str] = {}
        for c, x in names.items():
            if x[0] == "const":
                df = df.where(F.col(c) == x[1])
            elif x[1] in seen:
                df = df.where(F.col(c) == F.col(seen[x[1]]))
            else:
                seen[x[1]] = c
        return df.select(*[F.col(c).alias(n) for n, c in seen.items()])

    def edges(self, p, s=("var", ""), o=("var", "")) -> DataFrame:
        """(s, o) of a predicate or path."""
        kind = p[0]
        if kind == "const":
            ends = [x[1] if x[0] == "const" else None for x in (s, o)]
            virtual = relations.expand(self.quads, p[1], *ends)
            return virtual if virtual is not None else of_predicates(self.quads, [p[1]]).select("s", "o")
        if kind == "inv":
            return self.edges(p[1], o, s).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            out = self.edges(p[1][0])
            for x in p[1][1:]:
                out = out.unionByName(self.edges(x))
            return out
        if kind == "seq":
            out = self.edges(p[1][0])
            for x in p[1][1:]:
                out = out.withColumnRenamed("o", "m").join(self.edges(x).withColumnRenamed("s", "m"), "m").select("s", "o")
            return out
        if kind == "not":
            return self.quads.where(~F.col("p").isin(p[1])).select("s", "o")
        one = self.edges(p[1])
        if kind == "?":
            out = one
        elif s[0] == "const":
            out = traversal.reach(one, one.sparkSession.createDataFrame([(s[1],)], "s string"))
        elif o[0] == "const":
            back = one.select(F.col("o").alias("s"), F.col("s").alias("o"))
            out = traversal.reach(back, one.sparkSession.createDataFrame([(o[1],)], "s string")).select(F.col("o").alias("s"), F.col("s").alias("o"))
        else:
            out = traversal.reach(one)
        if kind == "+":
            return out.distinct()
        nodes = self.quads.select(F.col("s").alias("n")).unionByName(self.quads.select(F.col("o").alias("n"))).distinct()
        for x in (s, o):
            if x[0] == "const":
                nodes = nodes.where(F.col("n") == x[1]).unionByName(nodes.sparkSession.createDataFrame([(x[1],)], "n string")).distinct()
        return out.unionByName(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()

    @staticmethod
    def _apart(df: DataFrame, names: list[str]) -> DataFrame:
        return df.withColumnsRenamed({n: f"__r_{n}" for n in names})

    def _on(self, shared: list[str], unbound: set[str]) -> Column:
        on = F.lit(True)
        for n in shared:
            same = F.col(n) == F.col(f"__r_{n}")
            on = on & (same | F.col(n).isNull() | F.col(f"__r_{n}").isNull() if n in unbound else same)
        return on

    def join(self, left, maybe: set[str], right: DataFrame, unbound: set[str]) -> tuple[DataFrame, set[str]]:
        if left is None:
            return right, unbound
        shared = [n for n in left.columns if n in right.columns]
        if not shared:
            return left.crossJoin(right), maybe | unbound
        loose = {n for n in shared if n in maybe or n in unbound}
        if not loose:
            return left.join(right, shared), maybe | unbound
        both = left.join(self._apart(right, shared), self._on(shared, loose))
        out = [F.coalesce(n, f"__r_{n}").alias(n) if n in loose else F.col(n) for n in left.columns] + [F.col(n) for n in right.columns if n not in shared]
        return both.select(*out), {n for n in maybe | unbound if n not in loose or (n in maybe and n in unbound)}

    def optional(self, left, maybe: set[str], g: Group) -> tuple[DataFrame, set[str]]:
        left = self.unit() if left is None else left
        inner = Group([p for p in g.parts if p[0] != "filter"])
        right, unbound = self.group(inner)
        shared = [n for n in left.columns if n in right.columns]
        right = self._apart(right, shared)
        on = self._on(shared, {n for n in shared if n in maybe or n in unbound})
        both = [*left.columns, *right.columns]
        for f in g.parts:
            if f[0] == "filter":  # sees both sides: belongs into the condition
                on = on & F.coalesce(_bool(self.value(f[1], None, both)), F.lit(False))
        df = left.join(right, on, "left_outer")
        loose = {n for n in shared if n in maybe}
        out = [F.coalesce(n, f"__r_{n}").alias(n) if n in loose else F.col(n) for n in left.columns] + [F.col(n) for n in right.columns if not n.startswith("__r_")]
        return df.select(*out), maybe | unbound | {n for n in right.columns if not n.startswith("__r_")}

    def minus(self, left, maybe: set[str], right: DataFrame, unbound: set[str]) -> DataFrame:
        left = self.unit() if left is None else left
        shared = [n for n in left.columns if n in right.columns]
        if not shared:
            return left
        loose = {n for n in shared if n in maybe or n in unbound}
        if not loose:
            return left.join(right.select(*shared).distinct(), shared, "left_anti")
        bound = F.lit(False)
        for n in shared:
            bound = bound | (F.col(n).isNotNull() & F.col(f"__r_{n}").isNotNull())
        return left.join(self._apart(right.select(*shared).distinct(), shared), self._on(shared, loose) & bound, "left_anti")

    def exists(self, df: DataFrame, maybe: set[str], g: Group, negative: bool) -> DataFrame:
        inner = Group([p for p in g.parts if p[0] != "filter"])
        right, unbound = self.group(inner)
        shared = [n for n in df.columns if n in right.columns]
        right = self._apart(right, shared)
        on = self._on(shared, {n for n in shared if n in maybe or n in unbound})
        for f in g.parts:
            if f[0] == "filter":
                on = on & F.coalesce(_bool(self.value(f[1], None, [*df.columns, *right.columns])), F.lit(False))
        return df.join(right, on, "left_anti" if negative else "left_semi")

    def inline(self, names: list[str], rows: list[list[str | None]]) -> tuple[DataFrame, set[str]]:
        df = self.quads.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        return df, {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}

    # expressions
    def with_bounds(self, e, df: DataFrame) -> tuple[object, DataFrame]:
        """The expression with each accessor of a node's bounds reading a column joined to the frame: the accessor of a node
        takes the bounds that are stored for it, that of a text the text itself."""
        if not isinstance(e, tuple):
            return e, df
        if e and e[0] == "call" and e[1] in ACCESSORS and len(e[2]) == 1 and e[2][0][0] == "var" and e[2][0][1] in df.columns:
            n, made = e[2][0][1], f"__{ACCESSORS[e[1]]}_{e[2][0][1]}"
            if made not in df.columns:
                # spread by subject first: one file's rows would else be sorted by the task that reads them
                own = of_predicates(self.quads, [f"<{relations.SCHEMA}{ACCESSORS[e[1]]}>"]).repartition("s")
                held = own.groupBy(F.col("s").alias(n)).agg(F.min("o").alias(made))
                df = df.join(held.hint("merge"), n, "left").withColumn(made, F.when(terms.is_iri(F.col(n)), F.col(made)).otherwise(F.col(n)))
            return ("call", e[1], [("var", made)]), df
        out = []
        for x in e:
            if isinstance(x, list):
                made = []
                for y in x:
                    y, df = self.with_bounds(y, df)
                    made.append(y)
                x = made
            else:
                x, df = self.with_bounds(x, df)
            out.append(x)
        return tuple(out), df

    def value(self, e, df: DataFrame | None, names: list[str] | None = None):
        names = names if names is not None else df.columns
        sub = lambda x: self.value(x, df, names)
        kind = e[0]
        if kind == "var":
            if e[1] in names:
                key = F.col(f"`{e[1]}`")
                return ("term", key, None, F.col(f"`{NUMBER}{e[1]}`"), F.col(f"`{WHOLE}{e[1]}`")) if NUMBER + e[1] in names else ("term", key)
            return "term", (F.col(f"__r_{e[1]}") if f"__r_{e[1]}" in names else F.lit(None).cast("string"))
        if kind == "const":
            return "term", F.lit(e[1]), e[1]
        if kind in ("and", "or"):
            a, b = _bool(sub(e[1])), _bool(sub(e[2]))
            return "bool", (a & b if kind == "and" else a | b)
        if kind == "not":
            return "bool", ~_bool(sub(e[1]))
        if kind == "cmp":
            return "bool", self.compare(e[1], sub(e[2]), sub(e[3]))
        if kind == "in":
            v, test = sub(e[1]), F.lit(False)
            for x in e[2]:
                test = test | self.compare("=", v, sub(x))
            return "bool", test
        if kind == "arith":
            a, b = sub(e[2]), sub(e[3])
            x, y = _num(a), _num(b)
            if e[1] == "/":
                return "num", F.try_divide(x, y), F.lit(True)
            exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e[1]](_long(a), _long(b))
            return "num", {"+": x + y, "-": x - y, "*": x * y}[e[1]], _is_double(a) | _is_double(b), exact
        if kind == "agg":
            raise ValueError("an aggregate stands outside of SELECT, HAVING or ORDER BY")
        return self.call(e[1], e[2], sub, names)

    @staticmethod
    def compare(op: str, a, b) -> Column:
        plain = [len(v) == 3 and v[0] == "term" and not v[2].endswith(("^^Long", "^^Double")) for v in (a, b)]
        if "bool" in (a[0], b[0]):
            x, y = _bool(a), _bool(b)
        elif a[0] == b[0] == "term" and any(plain) and op in ("=", "!="):  # equal terms have equal keys: may reach the scan
            x, y = a[1], b[1]
        elif "num" in (a[0], b[0]):
            f = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
            return F.coalesce(f(_long(a), _long(b)), f(_num(a), _num(b)))
        elif "str" in (a[0], b[0]):
            x, y = _str(a), _str(b)
        else:
            na, nb = _num(a), _num(b)
            both = na.isNotNull() & nb.isNotNull()
            alike = F.when((terms.kind(a[1]) == terms.kind(b[1])) & ~terms.is_numeric(a[1]), True)
            x, y = terms.lexical(a[1]), terms.lexical(b[1])
            la, lb = _long(a), _long(b)
            if op == "=":
                return F.when(both, F.coalesce(la == lb, na == nb)).otherwise(a[1] == b[1])
            if op == "!=":
                return F.when(both, F.coalesce(la != lb, na != nb)).otherwise(a[1] != b[1])
            f = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
            return F.when(both, F.coalesce(f(la, lb), f(na, nb))).when(alike, f(x, y))
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def call(self, name: str, args: list, sub, names):
        if name == "BOUND":
            return "bool", _term(sub(args[0])).isNotNull()
        if name == "IF":
            a, b, c = (sub(x) for x in args)
            return "term", F.when(_bool(a), _term(b)).when(~_bool(a), _term(c))
        if name == "COALESCE":
            return "term", F.coalesce(*[_term(sub(x)) for x in args])
        v = [sub(x) for x in args]
        s = lambda i: _str(v[i])
        n = lambda i: _num(v[i])
        stamp = lambda: s(0).try_cast("timestamp")
        box = lambda: bounds.parse(s(0))
        text = {
            "STR": lambda: s(0), "UCASE": lambda: F.upper(s(0)), "LCASE": lambda: F.lower(s(0)), "CONCAT": lambda: F.concat(*[s(i) for i in range(len(v))]), "STRBEFORE": lambda: F.when(s(0).contains(s(1)), F.substring(s(0), F.lit(1), F.instr(s(0), s(1)) - 1)).when(s(0).isNotNull() & s(1).isNotNull(), ""),
            "SUBSTR": lambda: F.substring(s(0), n(1).cast("int"), n(2).cast("int")) if len(v) > 2 else F.substring(s(0), n(1).cast("int"), F.lit(2**31 - 1)),
            "REPLACE": lambda: F.regexp_replace(s(0), F.concat(self.flags(s(3)), s(1)) if len(v) > 3 else s(1), s(2)), "ENCODE_FOR_URI": lambda: F.replace(F.url_encode(s(0)), F.lit("+"), F.lit("%20")), "LANG": lambda: F.when(s(0).isNotNull(), ""), "MD5": lambda: F.md5(s(0)), "SHA1": lambda: F.sha1(s(0)),
            "SHA256": lambda: F.sha2(s(0), 256), "SHA384": lambda: F.sha2(s(0), 384), "SHA512": lambda: F.sha2(s(0), 512), "STRUUID": lambda: F.uuid(), "TZ": lambda: F.when(stamp().isNotNull(), self.zone(s(0))), "BOUNDS_CENTER": lambda: bounds.center(box()), "SEGMENT_CENTER": lambda: bounds.center(box()),
            "XYZT": lambda: bounds.text(bounds.parse(s(0))),
        }
        if name == "STRAFTER":
            return "str", F.when(s(0).contains(s(1)), F.substring(s(0), F.instr(s(0), s(1)) + F.length(s(1)), F.lit(2**31 - 1))).when(s(0).isNotNull() & s(1).isNotNull(), "")
        if name in text:
            return "str", text[name]()
        number = {
            "STRLEN": (lambda: F.length(s(0)), False), "ABS": (lambda: F.abs(n(0)), None), "CEIL": (lambda: F.ceil(n(0)), None), "FLOOR": (lambda: F.floor(n(0)), None), "ROUND": (lambda: F.floor(n(0) + 0.5), None), "RAND": (lambda: F.rand(), True),
            "YEAR": (lambda: F.year(stamp()), False), "MONTH": (lambda: F.month(stamp()), False), "DAY": (lambda: F.dayofmonth(stamp()), False), "HOURS": (lambda: F.hour(stamp()), False), "MINUTES": (lambda: F.minute(stamp()), False), "SECONDS": (lambda: F.second(stamp()), False),
            "DAYOFWEEK": (lambda: F.weekday(stamp()) + 1, False), "COSINE_SIM": (lambda: 1 - terms.cosine_distance(*[terms.elements(_term(x)) for x in v]), True), "BOUNDS_AREA": (lambda: bounds.area(bounds.parse(s(0))), True), "SEGMENT_AREA": (lambda: bounds.area(bounds.parse(s(0))), True),
            "WIDTH": (lambda: bounds.extent(bounds.parse(s(0)), "x"), True), "HEIGHT": (lambda: bounds.extent(bounds.parse(s(0)), "y"), True), "DEPTH": (lambda: bounds.extent(bounds.parse(s(0)), "z"), True), "DURATION": (lambda: bounds.extent(bounds.parse(s(0)), "t"), True),
            "INTEGER": (lambda: s(0).try_cast("double").cast("long"), False), "LONG": (lambda: s(0).try_cast("double").cast("long"), False), "INT": (lambda: s(0).try_cast("double").cast("long"), False), "DOUBLE": (lambda: s(0).try_cast("double"), True), "DECIMAL": (lambda: s(0).try_cast("double"), True), "FLOAT": (lambda: s(0).try_cast("double"), True),
        }
        if name in number:
            f, double = number[name]
            return "num", f().cast("double"), _is_double(v[0]) if double is None else F.lit(double)
        k = lambda: _term(v[0])
        test = {
            "CONTAINS": lambda: s(0).contains(s(1)), "STRSTARTS": lambda: s(0).startswith(s(1)), "STRENDS": lambda: s(0).endswith(s(1)), "ISIRI": lambda: terms.is_iri(k()), "ISURI": lambda: terms.is_iri(k()), "ISLITERAL": lambda: ~terms.is_iri(k()), "ISBLANK": lambda: F.lit(False), "ISNUMERIC": lambda: terms.is_numeric(k()),
            "SAMETERM": lambda: k() == _term(v[1]), "LANGMATCHES": lambda: F.lower(s(0)) == F.lower(s(1)), "REGEX": lambda: F.rlike(s(0), F.concat(self.flags(s(2)), s(1)) if len(v) > 2 else s(1)),
        }
        if name in test:
            return "bool", test[name]()
        if name in ("IRI", "URI"):
            return "term", terms.iri(s(0))
        if name == "STRING":
            return "str", s(0)
        if name == "DATETIME":
            return "term", terms.temporal(stamp())
        if name == "NOW":
            return "term", terms.temporal(F.current_timestamp())
        if name == "UUID":
            return "term", terms.iri(F.concat(F.lit("urn:uuid:"), F.uuid()))
        if name == "DATATYPE":
            return "term", terms.iri(F.concat(F.lit(XSD), F.lower(terms.kind(k()))))
        if name == "STRDT":
            kinds = F.lower(F.regexp_extract(s(1), r"([^#/]*)$", 1))
            whole, real = s(0).try_cast("long"), s(0).try_cast("double")
            return "term", F.when(kinds.isin("integer", "long", "int", "short", "byte"), terms.long(whole)).when(kinds.isin("double", "float", "decimal"), terms.double(real)).when(kinds.isin("datetime", "date"), terms.temporal(stamp())).otherwise(terms.string(s(0)))
        if name == "STRLANG":
            return "str", s(0)
        if name == "BNODE":
            return "term", terms.iri(F.concat(F.lit("urn:bnode:"), F.sha1(s(0)) if v else F.uuid()))
        if name == "BOOLEAN":
            return "bool", F.when(s(0).isin("true", "1"), True).when(s(0).isin("false", "0"), False)
        if name == "TIMEZONE":
            zone = self.zone(s(0))
            hours, minutes = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
            part = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
            return "str", F.when(zone == "Z", "PT0S").when(zone != "", F.when(part.endswith("PT"), "PT0S").otherwise(part))
        if name in FUNCTIONS:
            return FUNCTIONS[name](*v)
        raise ValueError(f"unknown function {name}")

    @staticmethod
    def flags(text: Column) -> Column:
        """The flags i, m, s and x of a pattern, ahead of it; q isn't known."""
        own = F.regexp_replace(text, "[^imsx]", "")
        return F.when(own != "", F.concat(F.lit("(?"), own, F.lit(")"))).otherwise("")

    @staticmethod
    def zone(text: Column) -> Column:
        """The zone that a time is written with: Z, an offset, or nothing."""
        return F.regexp_extract(text, r"T.*?(Z|[+-]\d\d:\d\d)$", 1)

    # aggregation and solution modifiers
    def select(self, q: Select) -> tuple[DataFrame, set[str]]:
        df, maybe = self.group(q.where)
        if q.values:
            df, maybe = self.join(df, maybe, *self.inline(*q.values))
        found: list[tuple[str, tuple]] = []

        def lift(e):
            """The expression with aggregates replaced by variables."""
            if not isinstance(e, tuple):
                return [lift(x) for x in e] if isinstance(e, list) else e
            if e and e[0] == "agg":
                for n, old in found:
                    if old == e:
                        return "var", n
                found.append((f"__agg{len(found)}", e))
                return "var", found[-1][0]
            return tuple(lift(x) for x in e)

        items = None if q.items is None else [(n, None if e is None else lift(e)) for n, e in q.items]
        having, order = [lift(e) for e in q.having], [(lift(e), down) for e, down in q.order]
        if found or q.grouped:
            for n, e in q.groups:
                df = df.withColumn(n, _term(self.value(e, df)))
            made = [self.aggregate(e, df).alias(n) for n, e in found] or [F.count(F.lit(1)).alias("__none")]
            df = (df.groupBy(*[n for n, _ in q.groups]) if q.groups else df.groupBy()).agg(*made)
            for e in having:
                df = df.where(F.coalesce(_bool(self.value(e, df)), F.lit(False)))
        for n, e in items or []:
            if e is not None:
                e, df = self.with_bounds(e, df)
                df = df.withColumn(n, _term(self.value(e, df)))
                maybe = maybe | {n}
        names = [n for n in df.columns if not n.startswith("__")] if items is None else [n for n, _ in items]
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
                maybe = maybe | {n}
        keys = []
        for e, down in order:
            k = _term(self.value(e, df))
            rank = F.when(k.isNull(), 0).when(terms.is_iri(k), 1).otherwise(2)
            for c in (rank, terms.number(k), terms.whole(k), terms.lexical(k)):
                keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if q.distinct:
            # sort keys that aren't selected have no meaning after DISTINCT
            df = df.select(*names).distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*names), maybe & set(names)

    def aggregate(self, e: tuple, df: DataFrame) -> Column:
        _, name, arg, distinct, sep = e
        if arg is None:
            return terms.long(F.count_distinct(F.struct(*df.columns)) if distinct else F.count(F.lit(1)))
        v = self.value(arg, df)
        k, n = _term(v), _num(v)
        if name == "COUNT":
            return terms.long(F.count_distinct(k) if distinct else F.count(k))
        if name == "SUM":
            add = F.sum_distinct if distinct else F.sum
            exact = F.coalesce(add(_long(v).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
            double = F.coalesce(F.bool_or(_is_double(v) & n.isNotNull()), F.lit(False))
            return F.when(double, terms.double(F.coalesce(add(n), F.lit(0.0)))).otherwise(F.concat(exact.cast("string"), F.lit("^^Long")))
        if name == "AVG":
            add, count = (F.sum_distinct, F.count_distinct) if distinct else (F.sum, F.count)
            exact = F.when(F.count(_long(v)) == F.count(n), add(_long(v).cast("decimal(20,0)")).cast("double"))
            return terms.double(F.coalesce(F.try_divide(F.coalesce(exact, add(n)), count(n)), F.lit(0.0)))
        if name in ("MIN", "MAX"):
            by = F.struct(F.when(n.isNotNull(), 1).otherwise(0), F.coalesce(n, F.lit(0.0)), F.coalesce(_long(v), F.lit(0)), terms.lexical(k))
            return F.min_by(k, F.when(k.isNotNull(), by)) if name == "MIN" else F.max_by(k, F.when(k.isNotNull(), by))
        if name == "SAMPLE":
            return F.any_value(k, True)
        items = F.collect_set(_str(v)) if distinct else F.collect_list(_str(v))
        return terms.string(F.array_join(F.array_sort(items), sep))


def select(query: str, quads: DataFrame) -> DataFrame:
    """The solutions of a SELECT query: one column of term keys per variable."""
    return Compiler(quads).select(Parser(query).query())[0]


def plain(df: DataFrame) -> DataFrame:
    """Solutions with bare texts instead of keys."""
    return df.select(*[terms.lexical(F.col(f"`{c}`")).alias(c) for c in df.columns])


def json_result(df: DataFrame) -> str:
    """The whole result in the W3C form: head with the variables, results with the bindings. For results that fit the driver."""
    rows = json_rows(df).toLocalIterator()
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": [json.loads(r.binding) for r in rows]}})


def table(df: DataFrame, rows: int = 20) -> str:
    """The first rows of a result, laid out for reading."""
    head = [tuple("" if v is None else str(v) for v in r) for r in plain(df).limit(rows).collect()]
    widths = [max([len(c), *(len(r[i]) for r in head)]) for i, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, head)])


def json_rows(df: DataFrame) -> DataFrame:
    """Solutions as result bindings: one JSON object of {type, value, datatype} per row."""
    types = F.create_map(*[F.lit(x) for kv in (("Long", "long"), ("Double", "double"), ("String", "string"), ("Temporal", "dateTime")) for x in kv])
    cells = [
        F.when(F.col(c).isNotNull(), F.struct(F.when(terms.is_iri(F.col(c)), "uri").otherwise("literal").alias("type"), terms.lexical(F.col(c)).alias("value"), F.concat(F.lit(XSD), F.coalesce(types[terms.kind(F.col(c))], F.when(~terms.is_iri(F.col(c)), "string"))).alias("datatype"))).alias(c)
        for c in df.columns
    ]
    return df.select(F.to_json(F.struct(*cells)).alias("binding"))
