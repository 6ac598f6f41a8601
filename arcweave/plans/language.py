"""The pattern language: tokens, syntax tree and a recursive-descent parser with one token of lookahead.

    query   = [as of (INT|STRING)] [match pattern+ [where or]] [delete ?v {, ?v}] [set ?v.p = term {, ...}]
              {create type(bindings) [as ?v]} {merge type(bindings) [as ?v]}
              [return item {, item} [,]] [order by key {, key} [,]] [limit INT]
    pattern = NAME [* | + | ? | {n,m}] "(" [name ":" term {, ...} [,]] ")" [as ?v]
    term    = ?v | _ | STRING | INT | FLOAT | true | false | null | uuid:...
    item    = ?v | ?v.p | count|sum|avg|min|max "(" [?v[.p]] ")"
    key     = ?v[.p] [asc|desc]

Keywords are case-insensitive, names are not; comments run from # to the line's end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from arcweave.errors import QueryError

MAX_DEPTH = 64


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A literal id (``uuid:...``)."""

    id: str


class Any_:
    """The term ``_``: something must be there."""


ANY = Any_()


@dataclass(frozen=True)
class Path:
    var: str
    prop: str | None = None

    @property
    def label(self) -> str:
        return f"{self.var}.{self.prop}" if self.prop else self.var


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Path | None

    @property
    def label(self) -> str:
        return f"{self.func}({self.arg.label if self.arg else ''})"


@dataclass
class Pattern:
    type: str
    bindings: list[tuple[str, Any]]
    var: str | None
    steps: tuple[int, int | None] | None = None  # recursion: at least, at most (None: up to the cap, else an error)


@dataclass(frozen=True)
class Cmp:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Bool:
    op: str  # and, or, not
    args: tuple


@dataclass
class Query:
    as_of: int | str | None = None
    patterns: list[Pattern] = field(default_factory=list)
    where: Any = None
    deletes: list[str] = field(default_factory=list)
    sets: list[tuple[Path, Any]] = field(default_factory=list)
    creates: list[Pattern] = field(default_factory=list)
    merges: list[Pattern] = field(default_factory=list)
    returns: list[Path | Agg] = field(default_factory=list)
    order: list[tuple[Path, bool]] = field(default_factory=list)
    limit: int | None = None


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    at: int


_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n]*)
    |(?P<uuid>uuid:[0-9A-Za-z][0-9A-Za-z:_-]*)
    |(?P<var>\?[A-Za-z_][A-Za-z0-9_]*)
    |(?P<float>-?\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+[eE][+-]?\d+)
    |(?P<int>-?\d+)
    |(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|!=|[=<>(){},:.*+?])""",
    re.X | re.S,
)


def lex(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise QueryError("lex_error", f"unexpected {source[at]!r}", at)
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            if bad := re.search(r'\\([^"\\ntr0])', text[1:-1].replace("\\\\", "")):
                raise QueryError("lex_error", f"unknown escape \\{bad.group(1)}", at)
            out.append(Token(kind, re.sub(r"\\(.)", lambda e: _ESCAPES[e.group(1)], text[1:-1], flags=re.S), at))
        elif kind == "int":
            if not -(2**63) <= int(text) < 2**63:
                raise QueryError("lex_error", "integer out of range", at)
            out.append(Token(kind, int(text), at))
        elif kind != "skip":
            value = {"float": float, "var": lambda t: t[1:], "uuid": lambda t: t[5:]}.get(kind, str)(text)
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", None, len(source))]


class Parser:
    def __init__(self, source: str):
        self.tokens, self.k = lex(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, wanted: str):
        raise QueryError("parse_error", f"expected {wanted}, found {self.now.value!r}", self.now.at)

    def word(self, *words: str) -> bool:
        return self.now.kind == "name" and self.now.value.lower() in words

    def take_word(self, word: str) -> bool:
        if self.word(word):
            self.k += 1
            return True
        return False

    def op(self, op: str) -> bool:
        if self.now.kind == "op" and self.now.value == op:
            self.k += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"'{op}'")

    def take(self, kind: str, what: str):
        if self.now.kind != kind:
            self.fail(what)
        self.k += 1
        return self.tokens[self.k - 1].value

    def listed(self, one, stop=()) -> list:
        out = [one()]
        while self.op(","):
            if self.now.kind == "end" or self.word(*stop):
                break
            out.append(one())
        return out

    def parse(self) -> Query:
        q = Query()
        if self.take_word("as"):
            if not self.take_word("of"):
                self.fail("'of'")
            if self.now.kind not in ("int", "string"):
                self.fail("a transaction or a time")
            q.as_of = self.now.value
            self.k += 1
        if matched := self.take_word("match"):
            while self.now.kind == "name" and not self.word("where", "delete", "set", "create", "merge", "return", "order", "limit"):
                q.patterns.append(self.pattern())
            if not q.patterns:
                self.fail("a pattern")
            if self.take_word("where"):
                q.where = self.either()
        if self.word("delete", "set") and not matched:
            self.fail("'match' before it")
        if self.take_word("delete"):
            q.deletes = self.listed(lambda: self.take("var", "a variable"))
        if self.take_word("set"):
            q.sets = self.listed(self.assignment)
        while self.take_word("create"):
            q.creates.append(self.pattern())
        while self.take_word("merge"):
            q.merges.append(self.pattern())
        if self.take_word("return"):
            q.returns = self.listed(self.item, ("order", "limit"))
        if self.take_word("order"):
            if not self.take_word("by"):
                self.fail("'by'")
            q.order = self.listed(self.key, ("limit",))
        if self.take_word("limit"):
            q.limit = self.take("int", "a number")
            if q.limit < 0:
                raise QueryError("parse_error", "limit is negative", self.now.at)
        if self.now.kind != "end":
            self.fail("the end")
        if not (q.patterns or q.creates or q.merges):
            self.fail("'match', 'create' or 'merge'")
        if not (q.returns or q.deletes or q.sets or q.creates or q.merges):
            self.fail("'return' or a write")
        return q

    def pattern(self) -> Pattern:
        name, steps = self.take("name", "a type"), None
        if self.op("*"):
            steps = (0, None)
        elif self.op("+"):
            steps = (1, None)
        elif self.op("?"):
            steps = (0, 1)
        elif self.op("{"):
            low = self.take("int", "a number")
            self.need(",")
            high = self.take("int", "a number")
            self.need("}")
            if not 0 <= low <= high <= MAX_DEPTH:
                raise QueryError("recursion_config_invalid", f"{{{low},{high}}} isn't within 0 to {MAX_DEPTH}", self.now.at)
            steps = (low, high)
        self.need("(")
        bindings = []
        while not self.op(")"):
            key = self.take("name", "a role or property")
            self.need(":")
            bindings.append((key, self.term()))
            if not self.op(","):
                self.need(")")
                break
        var = self.take("var", "a variable") if self.take_word("as") else None
        return Pattern(name, bindings, var, steps)

    def term(self):
        t = self.now
        if t.kind == "name" and t.value == "_":
            self.k += 1
            return ANY
        if t.kind == "name" and t.value.lower() in ("true", "false", "null"):
            self.k += 1
            return Lit({"true": True, "false": False, "null": None}[t.value.lower()])
        if t.kind in ("string", "int", "float"):
            self.k += 1
            return Lit(t.value)
        if t.kind in ("var", "uuid"):
            self.k += 1
            return Var(t.value) if t.kind == "var" else Ref(t.value)
        self.fail("a term")

    def path(self) -> Path:
        var = self.take("var", "a variable")
        return Path(var, self.take("name", "a property") if self.op(".") else None)

    def operand(self):
        if self.now.kind == "var":
            return self.path()
        if (term := self.term()) is ANY:
            raise QueryError("anonymous_term_in_filter", "_ has no value to compare", self.now.at)
        return term

    def either(self):
        args = [self.both()]
        while self.take_word("or"):
            args.append(self.both())
        return args[0] if len(args) == 1 else Bool("or", tuple(args))

    def both(self):
        args = [self.unit()]
        while self.take_word("and"):
            args.append(self.unit())
        return args[0] if len(args) == 1 else Bool("and", tuple(args))

    def unit(self):
        if self.take_word("not"):
            return Bool("not", (self.unit(),))
        if self.op("("):
            inner = self.either()
            self.need(")")
            return inner
        left = self.operand()
        for op in ("<=", ">=", "!=", "=", "<", ">"):
            if self.op(op):
                return Cmp(op, left, self.operand())
        self.fail("a comparison")

    def assignment(self) -> tuple[Path, Any]:
        path = self.path()
        if path.prop is None:
            self.fail("'.' and a property")
        self.need("=")
        return path, self.term()

    def item(self) -> Path | Agg:
        if self.now.kind == "var":
            return self.path()
        func = self.take("name", "a variable or an aggregate").lower()
        if func not in ("count", "sum", "avg", "min", "max"):
            self.k -= 1
            self.fail("a variable or an aggregate")
        self.need("(")
        arg = None if self.op(")") else self.path()
        if arg is not None:
            self.need(")")
        elif func != "count":
            self.fail(f"an argument of {func}")
        return Agg(func, arg)

    def key(self) -> tuple[Path, bool]:
        path = self.path()
        if self.take_word("desc"):
            return path, False
        self.take_word("asc")
        return path, True


def parse(source: str) -> Query:
    return Parser(source).parse()
