"""Browsing, graph and integrity views over incidence rows (edge_id, role, ord, filler) and entities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.functions.scalars import contains_ci, display, haversine_km, type_hint
from arcweave.sources.keys import is_id, visible
from arcweave.sources.lineage import cut


def degrees(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("filler").agg(F.count_distinct("edge_id").alias("degree"))


def edges_of(incidence: DataFrame, entity: str, most: int | None = None) -> DataFrame:
    found = incidence.where(F.col("filler") == entity).select("edge_id").distinct()
    return found if most is None else found.orderBy("edge_id").limit(most)


def traverse(incidences: list[DataFrame], start: DataFrame) -> DataFrame:
    """(start, node) after one undirected hop through each incidence in turn; the final hop only.

    A hop goes from a node to the other fillers of its edges; the start can come up again.
    """
    at = start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node")).distinct()
    for hop in incidences:
        here, there = hop.select("edge_id", F.col("filler").alias("node")), hop.select("edge_id", F.col("filler").alias("next"))
        at = at.join(here, "node").join(there, "edge_id").where("next <> node").select("start", F.col("next").alias("node")).distinct()
    return at


def bfs(edges: DataFrame, start: str, depth: int, limit: int) -> DataFrame:
    """(id, depth): the start and what directed edges (src, dst) reach in ``depth`` steps, nearest first, ``limit`` nodes in all.

    Of one step the smallest ids come first. Edges are filtered by the frontier, which has at most
    ``limit`` nodes, so each step is a broadcast of a bounded list.
    """
    seen, frontier = {start: 0}, [start]
    spark = edges.sparkSession
    for step in range(1, depth + 1):
        room = limit - len(seen)
        if room <= 0 or not frontier:
            break
        here = spark.createDataFrame([(x,) for x in frontier], edges.select("src").schema)
        known = spark.createDataFrame([(x,) for x in seen], edges.select("dst").schema)
        new = edges.join(F.broadcast(here), "src").select("dst").where("dst IS NOT NULL").distinct().join(F.broadcast(known), "dst", "left_anti")
        frontier = [r.dst for r in new.orderBy("dst").limit(room).collect()]
        seen |= dict.fromkeys(frontier, step)
    return spark.createDataFrame(list(seen.items()), "id string, depth int")


def references(df: DataFrame, props: dict[str, str], source: str, key: str = "id") -> DataFrame:
    """(source, from_id, prop, target, to_id): references by properties that hold an id; props: property to target type."""
    refs = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(t).alias("target"), F.col(p).cast("string").alias("to_id")) for p, t in props.items()])
    found = df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("from_id"), F.explode(refs).alias("r"))
    return found.select("source", "from_id", "r.prop", "r.target", "r.to_id").where("to_id IS NOT NULL")


def ego_whole(incidence: DataFrame, refs: DataFrame, entity: str) -> DataFrame:
    """(via, role, node, arity): an entity's neighbours by edges (``ego``), by its references (role `out:` and the property) and by those to it (`in:`)."""
    own = ego(incidence, entity)
    size = incidence.join(own.select("edge_id").distinct(), "edge_id").groupBy("edge_id").agg(F.count(F.lit(1)).alias("arity"))
    by_edge = own.join(size, "edge_id").select(F.col("edge_id").alias("via"), "role", "node", "arity")
    side = lambda at, other, way: refs.where(F.col(at) == entity).select(F.concat_ws(".", "source", "prop").alias("via"), F.concat(F.lit(f"{way}:"), "prop").alias("role"), F.col(other).alias("node"), F.lit(2).cast("long").alias("arity"))
    return by_edge.unionByName(side("from_id", "to_id", "out")).unionByName(side("to_id", "from_id", "in"))


def projection_whole(incidence: DataFrame, refs: DataFrame, limit: int | None = None) -> DataFrame:
    """``projection`` and references as links of kind `ref`; the first ``limit`` by source, target and kind."""
    whole = projection(incidence).unionByName(refs.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lit("ref").alias("kind")))
    return whole if limit is None else whole.orderBy("source", "target", "kind").limit(limit)


def record_summary(graph, entity_type: str, key: str, log: DataFrame | None = None, refs: DataFrame | None = None, vector: str | None = None) -> DataFrame:
    """One row: versions, deepest numbers of roles and co-members, references out and in, and the vector's dimension."""
    spark = graph.entities[entity_type].sparkSession
    parts = [spark.range(1).select(F.lit("versions").alias("what"), F.lit(0).cast("long").alias("n")) if log is None else log.where(is_id(log, "id", key)).agg(F.countDistinct("tx").alias("n")).select(F.lit("versions").alias("what"), "n")]
    for name in graph.edges:
        own = graph.edges[name].of(key)
        if "edge_id" in own.df.columns:
            rows = own.incidence()
            parts.append(rows.where(F.col("filler") == key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"roles:{name}").alias("what"), "n"))
            parts.append(rows.where(F.col("filler") != key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"members:{name}").alias("what"), "n"))
    if refs is not None:
        for way, at in (("out", "from_id"), ("in", "to_id")):
            parts.append(refs.where(F.col(at) == key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"references:{way}").alias("what"), "n"))
    if vector is not None:
        held = graph.entities[entity_type]
        parts.append(held.where(is_id(held, "id", key)).agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("long").alias("n")).select(F.lit("dimension").alias("what"), "n"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def top_degree(incidence: DataFrame, keep: int) -> DataFrame:
    """The incidence of the ``keep`` nodes with the most edges (ties: the smaller id), for drawing."""
    top = degrees(incidence).orderBy(F.col("degree").desc(), "filler").limit(keep).select("filler")
    return incidence.join(F.broadcast(top), "filler", "left_semi")  # ``keep`` ids


def ego(incidence: DataFrame, entity: str) -> DataFrame:
    """(edge_id, role, node): the edges of an entity with all others in them; its arity says how to draw it."""
    own = incidence.where(F.col("filler") == entity).select("edge_id").distinct()
    return incidence.join(own, "edge_id").where(F.col("filler") != entity).select("edge_id", "role", F.col("filler").alias("node"))


def projection(incidence: DataFrame) -> DataFrame:
    """(source, target, kind): an edge of two is a link; a larger one is a hub with a spoke for each filler."""
    arity = incidence.groupBy("edge_id").agg(F.count(F.lit(1)).alias("arity"), F.min(F.struct("role", "ord", "filler")).alias("a"), F.max(F.struct("role", "ord", "filler")).alias("b"))
    links = arity.where("arity = 2").select(F.col("a.filler").alias("source"), F.col("b.filler").alias("target"), F.lit("link").alias("kind"))
    spokes = incidence.join(arity.where("arity <> 2").select("edge_id"), "edge_id").select(F.col("edge_id").alias("source"), F.col("filler").alias("target"), F.lit("spoke").alias("kind"))
    return links.unionByName(spokes)


def inner_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose both ends are among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def dangling(incidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Incidence rows whose filler is no known id."""
    return incidence.join(ids.select(F.col("id").alias("filler")), "filler", "left_anti")


def resolve_roles(incidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Incidence with each filler's label (id, label), '' if there is none."""
    return incidence.join(labels.withColumnRenamed("id", "filler"), "filler", "left").withColumn("label", F.coalesce("label", F.lit("")))


def relationships(edge_type: str, incidence: DataFrame, kinds: DataFrame) -> DataFrame:
    """(edge, role, kind, n): how often each kind of entity (id, kind) fills each role."""
    return incidence.join(kinds.withColumnRenamed("id", "filler"), "filler").groupBy("role", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(edge_type).alias("edge"), "role", "kind", "n")


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(type, rows, properties): counts, and each type's properties with their kinds."""
    out = None
    for name, df in tables.items():
        props = ",".join(f"{f.name}:{type_hint(f.name, f.dataType)}" for f in df.schema.fields if f.name != "id" and f.name in visible(df.columns))
        own = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("type"), "rows", F.lit(props).alias("properties"))
        out = own if out is None else out.unionByName(own)
    return out


def browse(df: DataFrame, needle: str = "", by_column: dict[str, str] | None = None, sort: str | None = None, ascending: bool = True, offset: int = 0, limit: int = 50, tie: str = "id") -> DataFrame:
    """A page: rows that hold the needle anywhere and each column's own, sorted by display text, with the total."""
    for name, own in (by_column or {}).items():
        df = df.where(contains_ci(F.col(name), own))
    if needle:
        hit = F.lit(False)
        for f in df.schema.fields:
            if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
                hit = hit | contains_ci(F.col(f.name), needle)
        df = df.where(hit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    key = F.lower(display(F.col(sort or tie)))
    page = df.orderBy(key.asc() if ascending else key.desc(), tie).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def record_360(graph, entity_type: str, key: str) -> dict[str, DataFrame]:
    """A record's properties, its roles in every edge type with its co-members, and its edges' number."""
    out = {"properties": graph.entities[entity_type].where(is_id(graph.entities[entity_type], "id", key)).select(*visible(graph.entities[entity_type].columns))}
    for name, edge in graph.edges.items():
        if "edge_id" in edge.df.columns:
            own = edge.incidence()
            mine = own.where(F.col("filler") == key).select("edge_id", F.col("role").alias("as_role"))
            out[name] = own.join(mine, "edge_id").where(F.col("filler") != key)
    return out


def capability_check(capabilities: DataFrame, subject: str, action: str, target: str, now) -> DataFrame:
    """The grants that allow it: exact or `*` action and target, not expired (0 never does)."""
    return capabilities.where(
        (F.col("subject") == subject)
        & F.col("action").isin(action, "*")
        & F.col("target").isin(target, "*")
        & ((F.col("expires_at") == 0) | (F.col("expires_at") > now))
    )


def missing_property(df: DataFrame, prop: str) -> DataFrame:
    """Rows that break "required"."""
    return df.where(F.col(prop).isNull())


def interval_self_join(mains: DataFrame, others: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Pairs of a main row and a later one of the same keys within ``seconds``.

    Times go into buckets of the interval; a main row meets the buckets of its own and the next
    interval, so the join is on equality and no nested loop arises.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000))
    a = mains.select(*keys, *[F.col(c).alias(f"main_{c}") for c in mains.columns if c not in keys])
    a = a.withColumn("__b", F.explode(F.array(bucket(F.col(f"main_{time}")), bucket(F.col(f"main_{time}")) + 1)))
    b = others.withColumn("__b", bucket(F.col(time)))
    t0, t1 = F.unix_micros(F.col(f"main_{time}").cast("timestamp")), F.unix_micros(F.col(time).cast("timestamp"))
    return a.join(b, [*keys, "__b"]).where((t1 > t0) & (t1 <= t0 + seconds * 1_000_000)).drop("__b")


def radius_self_join(mains: DataFrame, others: DataFrame, time: str, seconds: int, lat: str, lon: str, km: float, size: str | None = None) -> DataFrame:
    """Pairs of a main row and a later one within ``seconds`` and ``km``, of less ``size`` if that is named.

    Needs no key: a cell is a band of latitude as wide as the radius and a stretch of time as long
    as the interval, and a main row meets its own band and the two beside it, now and next.
    """
    band = 180.0 / math.pi * km / 6371.0 * 1.000001
    at = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000))
    row = lambda c: F.floor(c / band)
    a = mains.select(*[F.col(c).alias(f"main_{c}") for c in mains.columns])
    near = lambda c, steps: F.explode(F.array(*[c + s for s in steps]))
    a = a.withColumn("__t", near(at(F.col(f"main_{time}")), (0, 1))).withColumn("__r", near(row(F.col(f"main_{lat}")), (-1, 0, 1)))
    b = others.withColumn("__t", at(F.col(time))).withColumn("__r", row(F.col(lat)))
    t0, t1 = F.unix_micros(F.col(f"main_{time}").cast("timestamp")), F.unix_micros(F.col(time).cast("timestamp"))
    hit = (t1 > t0) & (t1 <= t0 + seconds * 1_000_000) & (haversine_km(F.col(f"main_{lat}"), F.col(f"main_{lon}"), F.col(lat), F.col(lon)) <= km)
    if size:
        hit = hit & (F.col(size) < F.col(f"main_{size}"))
    return a.join(b, ["__t", "__r"]).where(hit).drop("__t", "__r")


def nearest_line(points: DataFrame, lines: DataFrame, within_km: float, key: str = "id") -> DataFrame:
    """``points`` (lat, lon, ...) with the ``key`` and km of the line (key, trace array<struct<lat, lon>>) whose vertex is closest; beyond ``within_km`` null.

    Ties go to the smaller key. Vertices lie in bands of latitude as wide as the bound; a point
    meets its own and the two beside it, so no point meets all lines.
    """
    band = 180.0 / math.pi * within_km / 6371.0 * 1.000001
    row = lambda c: F.floor(c / band)
    vertices = lines.select(F.col(key).alias("__k"), F.explode("trace").alias("v")).select("__k", F.col("v.lat").alias("__lat"), F.col("v.lon").alias("__lon"), row(F.col("v.lat")).alias("__r"))
    own = cut(points.withColumn("__n", F.monotonically_increasing_id()))
    asked = own.select("__n", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("__r", F.explode(F.array(*[row(F.col("lat")) + s for s in (-1, 0, 1)])))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    best = asked.join(vertices, "__r").select("__n", F.struct(km.alias("km"), F.col("__k").alias("k")).alias("b")).where(F.col("b.km") <= within_km).groupBy("__n").agg(F.min("b").alias("b"))
    return own.join(best, "__n", "left").select(*points.columns, F.col("b.k").alias(key), F.col("b.km").alias("km"))


def override(first: DataFrame, second: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``first``, and of ``second`` where the key isn't in it: of its repeated keys the row with the least ``order``, if that is named."""
    rest = second.join(first.select(key), key, "left_anti").select(*first.columns)
    if order is not None:
        whole = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in first.columns])
        rest = rest.groupBy(F.col(key).alias("__k")).agg(F.min(whole).alias("w")).select(*[F.col(f"w.`{c}`").alias(c) for c in first.columns])
    return first.unionByName(rest)


def ordered_lists(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, n, items): each group's values in the order of ``order``, nulls last, then by value."""
    item = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("o"), F.col(value).alias("v"))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias("items"))


def arg_max(df: DataFrame, group: str, by: str, key: str) -> DataFrame:
    """(group, by, key): of each group the highest ``by`` and the smallest key that has it; nulls are none."""
    top = F.min(F.when(F.col(by).isNotNull(), F.struct((-F.col(by)).alias("b"), F.col(key).alias("k")))).alias("t")
    return df.groupBy(group).agg(top).select(group, (-F.col("t.b")).alias(by), F.col("t.k").alias(key))


def money_sum(df: DataFrame, group: str, amount: str, scale: int = 2) -> DataFrame:
    """(group, total): exact sums of amounts at a fixed scale, as decimals of 38 digits."""
    return df.groupBy(group).agg(F.sum(F.col(amount).cast(f"decimal(18,{scale})")).cast(f"decimal(38,{scale})").alias("total"))


def _carried(df: DataFrame, order: str, one: Column, own: bool) -> DataFrame:
    """``df`` with ``_b`` and ``_a``: the last non-null ``one`` before each row in ``order`` and the first after it, the row itself included if ``own``.

    Rows lie in range partitions, each of which is gone through forwards and backwards; the ends of
    the partitions, a row each, carry on. ``one`` is a struct that begins with ``order``, in which no value repeats.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    ends = ranged.groupBy("_p").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
    low, high = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_p"), F.desc("_p")))
    ends = ends.select("_p", F.last("hi", True).over(low).alias("_below"), F.last("lo", True).over(high).alias("_above"))
    # Both ways the frame grows: one that shrinks (to unboundedFollowing) is gone through anew for each row.
    up, down = (Window.partitionBy("_p").orderBy(o).rowsBetween(Window.unboundedPreceding, 0 if own else -1) for o in (F.asc(order), F.desc(order)))
    return ranged.join(F.broadcast(ends), "_p").select(*df.columns, F.coalesce(F.last(one, True).over(up), "_below").alias("_b"), F.coalesce(F.last(one, True).over(down), "_above").alias("_a"))


def nearest(left: DataFrame, right: DataFrame, x: str, y: str, key: str, distance: str | None = None) -> DataFrame:
    """``left`` with the ``key`` of the ``right`` row whose ``y`` is nearest to ``x`` (ties: the least key), and its ``distance`` if that is named.

    Distinct values of both are put in order, where every value sees the nearest right values below
    and above. If a right value beyond those is no farther (infinite, NaN, or too large for the
    difference to show), the value meets all distinct right values. Null values have no nearest and
    null keys aren't any; no right rows give null keys.
    """
    own = right.where(f"{y} IS NOT NULL AND {key} IS NOT NULL").groupBy(F.col(y).alias("_v")).agg(F.min(key).alias("_k"))
    own = _carried(own, "_v", F.struct("_v", "_k"), False).select("_v", "_k", F.col("_b._v").alias("_lower"), F.col("_a._v").alias("_upper"))
    values = left.select(F.col(x).alias("_v")).where("_v IS NOT NULL").distinct()
    both = own.unionByName(values, allowMissingColumns=True).groupBy("_v").agg(*[F.min(c).alias(c) for c in ("_k", "_lower", "_upper")])
    seen = _carried(both, "_v", F.when(F.col("_k").isNotNull(), F.struct(*both.columns)), True)
    off = lambda c: F.abs(F.col("_v") - F.col(c))
    at = lambda d, k: F.struct(d.alias("d"), F.col(k).alias("k"))
    best = F.least(*[F.when(F.col(c).isNotNull(), at(off(f"{c}._v"), f"{c}._k")) for c in ("_b", "_a")])
    no_farther = lambda c: F.coalesce(off(c) <= F.col("_n.d"), F.lit(False))
    least = F.least(F.col("_n.d"), off("_b._lower"), off("_a._upper"))
    seen = cut(seen.withColumn("_n", best).select("_v", "_n", least.alias("_d"), (no_farther("_b._lower") | no_farther("_a._upper")).alias("_more")))
    found, more = seen.where("NOT _more").select("_v", "_n"), seen.where("_more").select("_v", "_d")
    if not more.isEmpty():
        pairs = more.repartition(left.sparkSession.sparkContext.defaultParallelism).crossJoin(own.select(F.col("_v").alias("_y"), "_k")).where(off("_y") == F.col("_d"))
        found = found.unionByName(pairs.groupBy("_v", "_d").agg(F.min("_k").alias("_k")).select("_v", at(F.col("_d"), "_k").alias("_n")))
    extra = [] if distance is None else [F.col("_n.d").alias(distance)]
    return left.join(found, left[x] == found["_v"], "left").select(*left.columns, F.col("_n.k").alias(key), *extra)
