"""From a parsed query to one DataFrame: greedy pattern order, natural joins, guarded filters.

Every pattern becomes a select over its typed table whose columns are its variables; patterns
join on the variables they share. The order puts a small or filtered pattern first, then always
one that shares a variable, and a recursion once its start is bound; Catalyst and adaptive
execution choose join strategies, push filters down and prune columns from there. Variables that
hold ids of one kind stay native keys until they are compared with text, ordered or returned.
"""

from __future__ import annotations

import datetime
import functools
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.errors import QueryError
from arcweave.operators.recursion import closure
from arcweave.plans.language import ANY, Agg, Bool, Cmp, Lit, Path, Pattern, Query, Ref, Var, parse
from arcweave.sources.graph import Edge, Graph
from arcweave.sources.keys import KIND, SUFFIX, is_id, key_in, kind_of, shown, visible

UNKNOWN = 10**10


def family(kind: T.DataType | None) -> str:
    """Types that compare with one another."""
    if kind is None:
        return "null"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return kind.typeName()


def literal_type(value) -> T.DataType | None:
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), datetime.datetime: T.TimestampType()}.get(type(value))


def compare(op: str, left: Column, right: Column, left_type, right_type) -> Column:
    """Two-valued: what is missing or of another kind compares false."""
    if family(left_type) != family(right_type) or left_type is None:
        return F.lit(False)
    found = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(found, F.lit(False))


def validate(query: Query, graph: Graph) -> None:
    known: set[str] = set()
    for p in query.patterns:
        if p.type not in graph.entities and p.type not in graph.edges:
            raise QueryError("unknown_type", p.type)
        if p.steps and p.type not in graph.edges:
            raise QueryError("recursion_on_entity_type", p.type)
        if p.type in graph.edges:
            roles, props = set(graph.edges[p.type].roles), set(graph.edges[p.type].props)
        else:
            roles, props = set(), set(visible(graph.entities[p.type].columns)) - {"id"}
        for name, term in p.bindings:
            if name not in roles | props:
                raise QueryError("unknown_role_or_property", f"{p.type}.{name}")
            if name in roles & props:
                raise QueryError("ambiguous_name", f"{p.type}.{name}")
            if name in roles and isinstance(term, Lit):
                raise QueryError("unknown_role_or_property", f"the role {name} takes a variable, _ or uuid:..., not a value")
            if isinstance(term, Var):
                known.add(term.name)
        if p.var:
            known.add(p.var)

    def paths(node):
        if isinstance(node, Path):
            yield node.var
        elif isinstance(node, Cmp):
            yield from (*paths(node.left), *paths(node.right))
        elif isinstance(node, Bool):
            for arg in node.args:
                yield from paths(arg)

    wanted = [*paths(query.where), *query.deletes, *(p.var for p, _ in query.sets), *(p.var for p, _ in query.order)]
    wanted += [i.var if isinstance(i, Path) else i.arg.var for i in query.returns if isinstance(i, Path) or i.arg]
    made = {p.var for p in (*query.creates, *query.merges) if p.var}
    if not query.patterns:
        known |= made
    for var in wanted:
        if var not in known:
            raise QueryError("unbound_variable", f"?{var}")


def variables(p: Pattern) -> set[str]:
    return {t.name for _, t in p.bindings if isinstance(t, Var)} | ({p.var} if p.var else set())


def order_patterns(patterns: list[Pattern], sizes: dict[str, float]) -> list[Pattern]:
    """Greedy: most shared variables, then the smallest estimate; a recursion only when one of its roles is bound."""

    def estimate(p: Pattern) -> float:
        fixed = sum(isinstance(t, (Lit, Ref)) for _, t in p.bindings)
        return sizes.get(p.type, UNKNOWN) / 10**fixed

    left, out, bound = list(enumerate(patterns)), [], set()
    while left:
        ready = [x for x in left if not x[1].steps or any(isinstance(t, Ref) or isinstance(t, Var) and t.name in bound for _, t in x[1].bindings)]
        if not ready:
            raise QueryError("recursion_config_invalid", "no role of the recursion is bound")
        linked = [x for x in ready if variables(x[1]) & bound] if bound else ready
        k, p = min(linked or ready, key=lambda x: (-len(variables(x[1]) & bound), estimate(x[1]), x[0]))
        left.remove((k, p))
        out.append(p)
        bound |= variables(p)
    return out


def sizes_of(graph: Graph, query: Query) -> dict[str, float]:
    """The planner's estimates; one pattern needs none."""
    return {p.type: graph.size(p.type) for p in query.patterns if not p.steps} if len(query.patterns) > 1 else {}


class Compiler:
    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph = spark, graph
        self.types: dict[str, set[str]] = {}  # a variable's possible entity or edge types
        self.count = 0

    def fresh(self) -> str:
        self.count += 1
        return f"__{self.count}"

    def columns(self, df: DataFrame, pairs: list[tuple[str, object]], roles: set[str], own: str | None = None) -> DataFrame:
        """``df`` filtered by its literal bindings, its variables' columns alone. ``own`` is the table's key, which is never null."""
        named: dict[str, list[str]] = {}
        for name, term in pairs:
            kind = df.schema[name].dataType
            if name in roles and isinstance(kind, T.ArrayType):
                df = df.withColumn(name, F.explode(name))
                kind = df.schema[name].dataType
            col = F.col(f"`{name}`")
            if isinstance(term, Lit):
                df = df.where(compare("=", col, F.lit(term.value), kind, literal_type(term.value)) if term.value is not None else col.isNull())
            elif isinstance(term, Ref):
                df = df.where(is_id(df, name, term.id))
            else:
                if name != own:
                    df = df.where(F.col(f"`{name}{SUFFIX}`" if kind_of(df, name) else f"`{name}`").isNotNull())
                if isinstance(term, Var):
                    named.setdefault(term.name, []).append(name)
        out = []
        for var, names in named.items():
            kinds = {kind_of(df, n) for n in names}
            native = len(kinds) == 1 and None not in kinds
            side = lambda n: F.col(f"`{n}{SUFFIX}`" if native else f"`{n}`")
            for other in names[1:]:
                df = df.where(side(names[0]) == side(other))
            out.append(side(names[0]).alias(var, metadata={KIND: kinds.pop()}) if native else F.col(f"`{names[0]}`").alias(var, metadata={}))
        return df.select(*out) if out else df.select(F.lit(1).alias(self.fresh()))

    def scan(self, p: Pattern) -> DataFrame:
        pairs = list(p.bindings)
        if p.type in self.graph.edges:
            edge, own = self.graph.edges[p.type], "edge_id"
            df, roles = edge.df, set(edge.roles)
            if p.var:
                if "edge_id" not in df.columns:
                    raise QueryError("unbound_variable", f"{p.type} has no edge ids for ?{p.var}")
                pairs.append(("edge_id", Var(p.var)))
        else:
            df, roles, own = self.graph.entities[p.type], set(), "id"
            if p.var:
                pairs.append(("id", Var(p.var)))
        if p.var:
            self.types.setdefault(p.var, set()).add(p.type)
        return self.columns(df, pairs, roles, own)

    @staticmethod
    def native(df: DataFrame, name: str) -> str | None:
        """The kind whose native keys a variable's column holds."""
        return df.schema[name].metadata.get(KIND)

    def text(self, df: DataFrame, name: str) -> Column:
        kind = self.native(df, name)
        return shown(kind, F.col(f"`{name}`")) if kind else F.col(f"`{name}`")

    def told(self, df: DataFrame, *names: str) -> DataFrame:
        """``df`` with the ids of ``names`` (none given: of all) as text."""
        wanted = {c for c in names or df.columns if self.native(df, c)}
        if not wanted:
            return df
        return df.select(*[self.text(df, c).alias(c, metadata={}) if c in wanted else F.col(f"`{c}`") for c in df.columns])

    def recursion(self, p: Pattern, bound: DataFrame | None) -> DataFrame:
        edge: Edge = self.graph.edges[p.type]
        roles = [(n, t) for n, t in p.bindings if n in edge.roles]
        start = next((x for x in roles if isinstance(x[1], Ref) or isinstance(x[1], Var) and bound is not None and x[1].name in bound.columns), None)
        end = next((x for x in roles if x is not start and isinstance(x[1], Var)), None)
        if start is None or end is None:
            raise QueryError("recursion_config_invalid", f"{p.type} needs a bound role and one with a variable")
        held = edge.df
        for name, term in p.bindings:
            if name in (start[0], end[0]):
                continue
            if isinstance(term, Ref):
                held = held.where(is_id(held, name, term.id))
            elif isinstance(term, Lit):
                held = held.where(compare("=", F.col(name), F.lit(term.value), held.schema[name].dataType, literal_type(term.value)))
            else:
                raise QueryError("recursion_config_invalid", f"{name} must be a literal in a recursion")
        for name in (start[0], end[0]):
            if isinstance(held.schema[name].dataType, T.ArrayType):
                held = held.withColumn(name, F.explode(name))
        # Nodes of one kind are walked by their native keys.
        kind = kind_of(held, start[0])
        whole = isinstance(start[1], Ref)
        if kind is not None and (kind != kind_of(held, end[0]) or kind != (kind if whole and key_in(kind, start[1].id) is not None else None if whole else self.native(bound, start[1].name))):
            kind = None
        step = lambda n: F.col(f"`{n}{SUFFIX}`" if kind else f"`{n}`")
        steps = held.select(step(start[0]).alias("src"), step(end[0]).alias("dst"))
        if whole:
            starts = self.spark.range(1).select(F.lit(key_in(kind, start[1].id)).cast("long").alias("start") if kind else F.lit(start[1].id).alias("start"))
        else:
            starts = (bound if kind else self.told(bound, start[1].name)).select(F.col(start[1].name).alias("start"))
        pairs = closure(steps, starts, *p.steps)
        meta = {KIND: kind} if kind else {}
        if whole:
            return pairs.select(F.col("end").alias(end[1].name, metadata=meta))
        if start[1].name == end[1].name:
            return pairs.where("start = end").select(F.col("start").alias(start[1].name, metadata=meta))
        return pairs.select(F.col("start").alias(start[1].name, metadata=meta), F.col("end").alias(end[1].name, metadata=meta))

    def match(self, query: Query) -> DataFrame:
        bound: DataFrame | None = None
        for p in order_patterns(query.patterns, sizes_of(self.graph, query)):
            own = self.recursion(p, bound) if p.steps else self.scan(p)
            if bound is None:
                bound = own
                continue
            shared = [c for c in bound.columns if c in own.columns]
            mixed = [c for c in shared if self.native(bound, c) != self.native(own, c)]
            if mixed:
                bound, own = self.told(bound, *mixed), self.told(own, *mixed)
            if not shared:
                warnings.warn(f"{p.type} shares no variable with the patterns before it: a Cartesian product", stacklevel=2)
            bound = bound.join(own, shared) if shared else bound.crossJoin(own)
        return bound

    def with_paths(self, df: DataFrame, paths: set[Path]) -> DataFrame:
        """``df`` and a column for each path: the property of the record that the variable names, or null."""
        for var in sorted({p.var for p in paths if p.prop}):
            props = sorted({p.prop for p in paths if p.var == var and p.prop})
            kind, sources = self.native(df, var), []
            types = self.types.get(var) or {n for n, t in self.graph.entities.items() if set(props) & set(t.columns)}
            for name in sorted(types):
                table = self.graph.entities[name] if name in self.graph.entities else self.graph.edges[name].df
                key = "id" if name in self.graph.entities else "edge_id"
                have = [p for p in props if p in table.columns]
                its = kind_of(table, key) if key in table.columns else None
                if have and not (kind and its and its != kind):  # another kind's ids are none of these
                    sources.append((its, table, key, have))
            if kind and {its for its, *_ in sources} - {kind}:
                df, kind = self.told(df, var), None
            made = [
                table.select(F.col(key + SUFFIX if kind else key).alias(var, metadata={}), *[F.col(p).alias(f"{var}.{p}") for p in have])
                for _, table, key, have in sources
            ]
            if made:
                df = df.join(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made), var, "left")
            for p in props:
                if f"{var}.{p}" not in df.columns:
                    df = df.withColumn(f"{var}.{p}", F.lit(None))
        return df

    def value(self, df: DataFrame, path: Path) -> tuple[Column, T.DataType]:
        if path.prop is None and self.native(df, path.label):
            return self.text(df, path.label), T.StringType()
        return F.col(f"`{path.label}`"), df.schema[path.label].dataType

    def condition(self, node, df: DataFrame) -> Column:
        def side(x) -> tuple[Column, T.DataType | None]:
            if isinstance(x, Path):
                return self.value(df, x)
            if isinstance(x, Ref):
                return F.lit(x.id), T.StringType()
            return F.lit(x.value), literal_type(x.value)

        if isinstance(node, Bool):
            args = [self.condition(a, df) for a in node.args]
            if node.op == "not":
                return ~args[0]
            return functools.reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), args)
        # Two ids of one kind compare by their keys; their order is that of their text.
        both = [x.label for x in (node.left, node.right) if isinstance(x, Path) and x.prop is None]
        if node.op in ("=", "!=") and len(both) == 2 and self.native(df, both[0]) and self.native(df, both[0]) == self.native(df, both[1]):
            return compare(node.op, F.col(f"`{both[0]}`"), F.col(f"`{both[1]}`"), T.LongType(), T.LongType())
        (a, ta), (b, tb) = side(node.left), side(node.right)
        return compare(node.op, a, b, ta, tb)

    def paths_in(self, node) -> set[Path]:
        if isinstance(node, Path):
            return {node}
        if isinstance(node, Cmp):
            return self.paths_in(node.left) | self.paths_in(node.right)
        if isinstance(node, Bool):
            return set().union(*(self.paths_in(a) for a in node.args))
        return set()

    def aggregate(self, agg: Agg, df: DataFrame) -> Column:
        if agg.arg is None:
            return F.count(F.lit(1)).alias(agg.label)
        if agg.func == "count":
            return F.count(F.col(f"`{agg.arg.var}`")).alias(agg.label)
        col, kind = self.value(df, agg.arg)
        number = col.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        made = {"sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)), "avg": lambda: F.avg(number), "min": lambda: F.min(col), "max": lambda: F.max(col)}
        return made[agg.func]().alias(agg.label)

    def bindings(self, query: Query, told: bool = True) -> DataFrame:
        """The rows of the variables; ids as text if ``told``."""
        df = self.match(query)
        if query.where is not None:
            df = self.with_paths(df, self.paths_in(query.where))
            df = df.where(self.condition(query.where, df))
        return self.told(df) if told else df

    def read(self, query: Query) -> DataFrame:
        return self.project(query, self.bindings(query, told=False))

    def project(self, query: Query, df: DataFrame) -> DataFrame:
        """What ``return``, ``order by`` and ``limit`` make of the variables' rows."""
        items = query.returns
        used = {i for i in items if isinstance(i, Path)} | {i.arg for i in items if isinstance(i, Agg) and i.arg} | {p for p, _ in query.order}
        df = self.with_paths(df, {p for p in used if p.label not in df.columns})
        tick = lambda label: F.col(f"`{label}`")
        keys = [tick(p.label).asc_nulls_last() if up else tick(p.label).desc_nulls_first() for p, up in query.order]
        if any(isinstance(i, Agg) for i in items):
            groups = [i.label for i in items if isinstance(i, Path)]
            df = df.groupBy(*[tick(g) for g in groups]).agg(*[self.aggregate(i, df) for i in items if isinstance(i, Agg)])
            keys = [k for k, (p, _) in zip(keys, query.order) if p.label in groups]
        df = self.told(df)
        if keys:
            df = df.orderBy(*keys)
        if query.limit is not None:
            df = df.limit(query.limit)
        return df.select(*[tick(i.label) for i in items]) if items else df.drop(*[c for c in df.columns if c.startswith("__")])


def run(spark: SparkSession, graph: Graph, source: str | Query) -> DataFrame:
    """The rows of a reading query; its columns are named as its items are written."""
    query = parse(source) if isinstance(source, str) else source
    if query.deletes or query.sets or query.creates or query.merges:
        raise QueryError("parse_error", "a writing query; see arcweave.operators.writes.execute")
    held = graph.at(query.as_of)
    validate(query, held)
    return Compiler(spark, held).read(query)


def run_truncated(spark: SparkSession, graph: Graph, source: str) -> tuple[DataFrame, bool]:
    """The rows, and whether the limit left any out."""
    query = parse(source)
    if query.limit is None:
        return run(spark, graph, query), False
    n, query.limit = query.limit, query.limit + 1
    more = run(spark, graph, query)
    return more.limit(n), len(more.take(n + 1)) > n


def explain(graph: Graph, source: str) -> list[str]:
    """The order in which the patterns join."""
    query = parse(source)
    held = graph.at(None) if query.as_of is None else graph
    return [p.type for p in order_patterns(query.patterns, sizes_of(held, query))]
