"""Graph operators on nodes(id, type, name, first_appearance) and edges(edge_id, src, dst, relation, strength, chapter)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from .scale import heavy, marked, marks, numbered, settle

#: Rows of one node that a task of a join over nodes gets from either side; edges that a task of a join over paths holds on average.
HUB_ROWS, TASK_EDGES = 100_000, 150_000


def upsert(rows: DataFrame, key: str = "id", version: str = "last_modified") -> DataFrame:
    """Last write per id, by partial maxima instead of a window."""
    rest = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("b"))
    return best.select(key, f"b.{version}", *[f"b.{c}" for c in rest])


def chapter_index(nodes: DataFrame) -> DataFrame:
    """Events per chapter as rows (chapter, id)."""
    return nodes.filter("type = 'EVENT'").select(F.col("first_appearance").alias("chapter"), "id")


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind).select("id", F.coalesce("name", "id").alias("name"), F.coalesce("first_appearance", F.lit(1)).alias("first_appearance"))


def undirected(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.lit("incoming").alias("direction"))
    return out.unionByName(back).groupBy("node", "next").agg(F.max("direction").alias("direction"))


def split(edges: DataFrame, node: str, ranges: int = 8) -> tuple[DataFrame, DataFrame]:
    """(edges with ``_part``, directory of (node, _part)): the edges of a node are dealt to ranges, a hub to as many as its degree asks for.

    ``ranges`` per shuffle partition keep parts small against a partition. The
    directory has one row per node and part, so a frontier that joins it goes
    to every part of its hubs, and no task meets a hub whole.
    """
    rest = [c for c in edges.columns if c != node]
    n = ranges * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are found from a sample, so the edges are written before.
    parts = settle(settle(edges).repartitionByRange(n, F.col(node), *[F.col(c) for c in rest]).withColumn("_part", F.spark_partition_id()))
    return parts, settle(parts.select(node, "_part").distinct())


def expand(front: DataFrame, parts: DataFrame, directory: DataFrame, node: str) -> DataFrame:
    """``front`` joined with the edges of its ``node``, part by part."""
    return front.join(directory, node).join(parts, [node, "_part"]).drop("_part")


def grid(into: DataFrame | None, out: DataFrame | None) -> DataFrame | None:
    """(src, _cols, _parts) of hubs, from the (src, n) of nodes that many rows reach and of nodes that many edges leave; None if there are none."""
    size = lambda df, name: df.select("src", F.ceil(F.col("n") / HUB_ROWS).cast("int").alias(name))
    if into is None or out is None:
        one, name = (out, "_cols") if into is None else (into, "_parts")
        return None if one is None else settle(size(one, "_parts" if name == "_cols" else "_cols").withColumn(name, F.lit(1)))
    both = size(into, "_cols").join(size(out, "_parts"), "src", "full")
    return settle(both.select("src", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_cols", "_parts")]))


def deal(rows: DataFrame, hubs: DataFrame | None, by: str, own: str, other: str) -> tuple[DataFrame, list[str]]:
    """``rows`` of a node ``src`` for a join on the returned keys: those of a hub are dealt to its ``own`` by a hash of ``by``, and go to each of its ``other``.

    So a pair of rows of the two sides meets once, and no task meets a hub whole.
    Other nodes have one task, and none of their rows is doubled.
    """
    if hubs is None:
        return rows, ["src"]
    most = lambda name: F.coalesce(name, F.lit(1))
    return rows.join(F.broadcast(hubs), "src", "left").select(
        *rows.columns, F.pmod(F.xxhash64(by), most(own)).cast("int").alias(own[:-1]), F.explode(F.sequence(F.lit(0), most(other) - 1)).alias(other[:-1])), ["src", "_col", "_part"]


def meet(front: DataFrame, edges: DataFrame, hubs: DataFrame | None, by: str) -> DataFrame:
    """``front`` (src, ``by``, ...) joined with the edges (src, dst, ...) of its node, hubs in parts."""
    left, keys = deal(front, hubs, by, "_cols", "_parts")
    return left.join(deal(edges, hubs, "dst", "_parts", "_cols")[0], keys).drop("_col", "_part")


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(start, node, hop, direction) of every node first reached at each hop, edges taken both ways; hubs are expanded in parts."""
    near, directory = split(undirected(edges), "node")
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hop"), F.lit("").alias("direction"))
    front = seen
    for hop in range(1, hops + 1):
        # Distinct pairs are made before the anti join, so a node reached many ways counts once.
        step = expand(front.select("start", "node"), near, directory, "node").groupBy("start", F.col("next").alias("node")).agg(F.max("direction").alias("direction"))
        front = settle(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)).select("start", "node", "hop", "direction"))
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def relation_path(starts: DataFrame, edges: DataFrame, path: list[str]) -> DataFrame:
    """Rows (start, step, node, via) along an ordered list of relations; the frontier is distinct per step."""
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("via"))
    out = None
    for i, rel in enumerate(path, 1):
        hit = front.join(edges.filter(F.col("relation") == rel).select(F.col("src").alias("via"), F.col("dst").alias("node")), "via")
        rows = hit.select("start", F.lit(i).alias("step"), "node", "via")
        out = rows if out is None else out.unionByName(rows)
        front = hit.select("start", F.col("node").alias("via")).distinct()
    return out


def snapshot(nodes: DataFrame, edges: DataFrame, chapter: int) -> tuple[DataFrame, DataFrame]:
    n = nodes.filter(F.col("first_appearance") <= chapter)
    e = edges.filter(F.col("chapter") <= chapter)
    return n, between(e, n, n)


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose ends are in the two node sets."""
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def ties_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions of every edge of a character: (id, other, relation, strength, direction)."""
    chars = nodes.filter("type = 'CHARACTER'").select("id")
    half = lambda a, b, d: edges.select(F.col(a).alias("id"), F.col(b).alias("other"), F.coalesce("relation", F.lit("UNKNOWN")).alias("relation"),
                                        F.coalesce("strength", F.lit(0.5)).alias("strength"), F.lit(d).alias("direction"))
    return half("src", "dst", "outgoing").unionByName(half("dst", "src", "incoming")).join(chars, "id", "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, key, n): totals and counts by type, relation and chapter from grouping sets."""
    n = nodes.groupingSets([[], [F.col("type")]], F.col("type")).agg(F.count(F.lit(1)).alias("n"), F.grouping("type").alias("g"))
    e = edges.groupingSets([[], [F.col("relation")]], F.col("relation")).agg(F.count(F.lit(1)).alias("n"), F.grouping("relation").alias("g"))
    ch = chapter_index(nodes).agg(F.count_distinct("chapter").alias("n"))
    label = lambda d, key, what: d.select(F.when(F.col("g") == 1, what).otherwise(f"{what} by {key}").alias("measure"), F.coalesce(key, F.lit("")).alias("key"), "n")
    return label(n, "type", "nodes").unionByName(label(e, "relation", "edges")).unionByName(ch.select(F.lit("chapters").alias("measure"), F.lit("").alias("key"), "n"))


def conflicting_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, first, second) where one pair of nodes has two relations that exclude each other.

    One flag per relation that matters, so nothing is collected per pair.
    """
    wanted = sorted({r for p in lexicons.CONFLICTING_PAIRS for r in p})
    flags = edges.filter(F.col("relation").isin(*wanted)).groupBy("src", "dst").agg(*[F.bool_or(F.col("relation") == r).alias(r) for r in wanted])
    both = F.array_compact(F.array(*[F.when(F.col(a) & F.col(b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in lexicons.CONFLICTING_PAIRS]))
    return flags.select("src", "dst", F.explode(both).alias("p")).select("src", "dst", "p.*")


def orphaned_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Events after chapter one that nothing causes."""
    caused = edges.filter("relation = 'CAUSED_BY'").select(F.col("dst").alias("id"))
    return nodes.filter("type = 'EVENT' AND first_appearance > 1").join(caused, "id", "left_anti")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the first inserted of the parallel ones."""
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("edge_id", "relation", "strength")).alias("b"))
    return best.select("src", "dst", F.coalesce("b.relation", F.lit("UNKNOWN")).alias("relation"), F.coalesce("b.strength", F.lit(0.5)).alias("strength"))


def best_ahead(edges: DataFrame, hops: int) -> list[DataFrame]:
    """For 1 to ``hops`` edges the table (node, best): the greatest product of strengths of a walk of exactly so many edges from a node.

    Walks may repeat nodes, so the product of a simple path is never above it;
    this holds for strengths of any size from 0. The greatest product per node
    is a partial maximum, so a hub sends one row per task.
    """
    out = []
    for left in range(1, hops + 1):
        rows = edges.select(F.col("src").alias("node"), "dst", F.col("strength").alias("best")) if left == 1 else edges.join(
            out[-1].select(F.col("node").alias("dst"), F.col("best").alias("_on")), "dst").select(F.col("src").alias("node"), "dst", (F.col("strength") * F.col("_on")).alias("best"))
        out.append(settle(rows.groupBy("node").agg(F.max("best").alias("best"))))
    return out


def _with_ahead(edges: DataFrame, hops: int) -> DataFrame:
    """Edges (last, next, relation, strength) with ``ahead_h`` for every place h of 1 to ``hops`` in a path: the best product of what may still follow, or null."""
    out = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"), "relation", "strength")
    for left, table in enumerate(best_ahead(edges, hops - 1), 1):
        out = out.join(table.select(F.col("node").alias("next"), F.col("best").alias(f"_best_{left}")), "next", "left")
    # A path has two edges at least, so after the first one more must come; later it may end.
    ends = lambda h: F.lit(1.0) if h > 1 else F.lit(None).cast("double")
    best = lambda h: F.greatest(ends(h), F.lit(None).cast("double"), *[F.col(f"_best_{k}") for k in range(1, hops - h + 1)])
    return out.select("last", "next", "relation", "strength", *[best(h).alias(f"ahead_{h}") for h in range(1, hops + 1)])


def _extended(starts: DataFrame, edges: DataFrame, hops: int, least: float, names: DataFrame | None = None):
    """Frontier after each hop: simple paths that can still end with a product of ``least``; with ``names`` (id, name) also those of their nodes."""
    ties, starts = _with_ahead(settle(first_edges(edges)), hops), starts.select("id")
    if names is not None:
        # Names go to edges and starts, of which there are far fewer than paths.
        ties = ties.join(names.select(F.col("id").alias("next"), F.col("name").alias("next_name")), "next").select("last", "next", *[c for c in ties.columns if c not in ("last", "next")], "next_name")
        starts = starts.join(names.select("id", "name"), "id")
    parts, directory = split(ties, "last")
    named = lambda made: [] if names is None else [made().alias("names")]
    front = starts.select(F.array("id").alias("path"), F.col("id").alias("last"), F.array().cast("array<string>").alias("relations"), F.lit(1.0).alias("weight"), *named(lambda: F.array("name")))
    for hop in range(1, hops + 1):
        weight = F.col("weight") * F.col("strength")
        enough = (weight * F.col(f"ahead_{hop}") * (1 + 1e-9) + 1e-9 >= least) & ~F.array_contains("path", F.col("next"))
        front = expand(front, parts, directory, "last").filter(enough).select(
            F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"),
            F.concat("relations", F.array("relation")).alias("relations"), weight.alias("weight"),
            *named(lambda: F.concat("names", F.array("next_name"))))
        if 1 < hop < hops:
            front = settle(front)
        yield hop, front.filter(F.round("weight", 9) >= least)


def indirect_paths(starts: DataFrame, edges: DataFrame, hops: int = 3, least: float = 0.3, names: DataFrame | None = None) -> DataFrame:
    """Simple paths of 2..hops edges with a strength product of at least ``least``, one row each.

    A prefix goes on only where the best product of what may follow
    (:func:`best_ahead`) can lift it to ``least``, so no prefix is made in vain
    for a bound of walks, whatever the strengths. See :func:`path_table` for a
    form that grows with the pairs, not with the paths. With ``names`` (id,
    name) a row has the array ``names`` of its nodes, as inner joins of every
    node would give them, and no path is shuffled for it.
    """
    out = None
    for hop, front in _extended(starts, edges, hops, least, names):
        if hop > 1:
            out = front if out is None else out.unionByName(front)
    return out.select(F.col("path")[0].alias("source"), F.col("last").alias("target"), "path", "relations", F.size("relations").alias("hops"), "weight",
                      *([] if names is None else ["names"]))


def _path_hubs(ties: DataFrame, hops: int, mean: float) -> DataFrame | None:
    """:func:`grid` for the frontiers of ``hops`` steps over ties (src, dst): a node's rows are estimated from those of the hubs before it and ``mean`` ties into each other node."""
    out, into, most = heavy(ties, "src", HUB_ROWS), None, None
    for hop in range(1, hops):
        usual = F.lit(mean ** (hop - 1))
        rows, n = (ties, usual) if into is None else (ties.join(F.broadcast(into), "src", "left"), F.coalesce("n", usual))
        into = heavy(rows.select(F.col("dst").alias("src"), n.alias("n")), "src", HUB_ROWS, F.col("n"))
        most = into if most is None else most if into is None else most.unionByName(into)
    return grid(None if most is None else most.groupBy("src").agg(F.max("n").alias("n")), out)


def path_table(starts: DataFrame, edges: DataFrame, hops: int = 3, least: float = 0.3) -> DataFrame:
    """(source, target, hops, pred, n_paths, best): the same paths by the node before their target, with their number and best product.

    Paths are counted where they are made and never written out; a path is
    read backwards along ``pred``. Edges are dealt by their source once, and
    every hop joins that shuffle. The groups of a hop hold the node that was
    joined on, so they need no shuffle of their own, and a path of two edges is
    alone in its group. Where no strength is above one, none can lift a weak
    prefix, so every prefix of two edges that goes on is a row of the result;
    only else the bounds of :func:`best_ahead` are worked out.
    """
    ties, strength = edges.select("src", "dst", "edge_id", "relation", "strength").filter("src IS NOT NULL AND dst IS NOT NULL"), F.coalesce("strength", F.lit(0.5))
    seen = ties.agg(F.min(strength).alias("low"), F.max(strength).alias("top"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("dst").alias("ends")).first()
    known = seen.low is None or 0 <= seen.low and seen.top <= 1
    if not known:
        ties = settle(_with_ahead(settle(first_edges(ties)), hops)).withColumnsRenamed({"last": "src", "next": "dst"})
    hubs, tasks = _path_hubs(ties.select("src", "dst"), hops, seen.n / max(1, seen.ends)), math.ceil(seen.n / TASK_EDGES)
    dealt, keys = deal(ties, hubs, "dst", "_parts", "_cols")
    rest = [c for c in ties.columns if c not in ("src", "dst")]
    many = [tasks] if tasks > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    first = dealt.repartition(*many, *keys).groupBy(*keys, "dst").agg(F.min(F.struct(*rest)).alias("b")).select(*keys, "dst", "b.*").withColumn("strength", strength)
    front, out, nodes = starts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.col("id").alias("source"), F.col("id").alias("src"), "n", F.lit(1.0).alias("weight")), None, ["source"]
    for hop in range(1, hops + 1):
        weight = F.col("weight") * F.col("strength")
        enough = weight * (F.lit(1.0) if known else F.col(f"ahead_{hop}")) * (1 + 1e-9) + 1e-9 >= least
        for n in (*nodes, "src"):
            enough = enough & (F.col("dst") != F.col(n))
        step = deal(front, hubs, "source", "_cols", "_parts")[0].join(first, keys).filter(enough).withColumn("weight", weight)
        if hop > 1:
            ended, key = step.filter(F.round("weight", 9) >= least), [F.col("source"), F.col("dst").alias("target"), F.lit(hop).alias("hops"), F.col("src").alias("pred")]
            rows = ended.select(*key, F.col("n").alias("n_paths"), F.col("weight").alias("best")) if hop == 2 else ended.groupBy(*keys, "source", "dst").agg(
                F.sum("n").alias("n_paths"), F.max("weight").alias("best")).select(*key, "n_paths", "best")
            out = rows if out is None else out.unionByName(rows)
        front = step.select(*nodes, *([F.col("src").alias(f"v{hop}")] if hop > 1 else []), F.col("dst").alias("src"), "n", "weight")
        nodes += [f"v{hop}"] if hop > 1 else []
    return out


# Readings of two-step connections; {0} {1} {2} are the names.
READINGS = {
    ("ALLIES_WITH", "CONFLICTS_WITH"): "{0}'s ally {1} is enemies with {2} (potential loyalty conflict)",
    ("CONFLICTS_WITH", "ALLIES_WITH"): "{0}'s enemy {1} is allied with {2} (common threat)",
    ("MEMBER_OF", "CONFLICTS_WITH"): "{0} belongs to {1} which opposes {2}",
    ("ALLIES_WITH", "ALLIES_WITH"): "{0} and {2} share a mutual friend: {1}",
    ("CONFLICTS_WITH", "CONFLICTS_WITH"): "{0} and {2} share a common enemy: {1}",
}


def readings(paths: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Text for two-step paths whose three names are columns."""
    def fill(template):
        out = F.lit(template)
        for i, n in enumerate(names):
            out = F.replace(out, F.lit("{%d}" % i), F.col(n))
        return out

    text = fill("{0} connected to {2} through {1}")
    for (a, b), template in READINGS.items():
        text = F.when((F.col("relations")[0] == a) & (F.col("relations")[1] == b), fill(template)).otherwise(text)
    return paths.withColumn("reading", text)


def hidden_connections(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Simple paths of two to four edges between given pairs (a, b), meeting in the middle.

    Two steps are made from each a and two back from each b; three and four
    step paths come from an equi-join on (middle, b), so no path is extended
    that cannot arrive. Hubs are expanded in parts.
    """
    e = first_edges(edges).select("src", "dst", "strength")
    out, out_parts = split(e, "src")
    into, into_parts = split(e, "dst")
    leave = lambda front, node, to, w: expand(front.withColumnRenamed(node, "src"), out, out_parts, "src").withColumnsRenamed({"src": node, "dst": to, "strength": w})
    arrive = lambda front, node, of, w: expand(front.withColumnRenamed(node, "dst"), into, into_parts, "dst").withColumnsRenamed({"dst": node, "src": of, "strength": w})
    pairs = pairs.select("a", "b").distinct()
    one = leave(pairs, "a", "x", "w").filter("x <> b")
    two = settle(leave(one, "x", "m", "w2").filter("m <> a").select("a", "b", "x", "m", (F.col("w") * F.col("w2")).alias("w")))
    p2 = two.filter("m = b").select("a", "b", F.array("a", "x", "b").alias("path"), "w")
    open2 = two.filter("m <> b")
    p3 = open2.join(out.select(F.col("src").alias("m"), F.col("dst").alias("b"), F.col("strength").alias("w3")), ["m", "b"]).select(
        "a", "b", F.array("a", "x", "m", "b").alias("path"), (F.col("w") * F.col("w3")).alias("w"))
    back = arrive(arrive(pairs.select("b").distinct(), "b", "y", "w3"), "y", "m", "w4")
    p4 = open2.join(back, ["m", "b"]).filter("y <> a AND y <> x AND y <> m AND y <> b").select(
        "a", "b", F.array("a", "x", "m", "y", "b").alias("path"), (F.col("w") * F.col("w4") * F.col("w3")).alias("w"))
    return p2.unionByName(p3).unionByName(p4).select("a", "b", "path", (F.size("path") - 1).alias("hops"), F.col("w").alias("weight"))


def conflict_triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a allied with b, b allied with c, a in conflict with c; once per set of three.

    Starts from the conflicts, so the last join is an equi-join on (b, c) and no
    open wedge is kept.
    """
    chars = nodes.filter("type = 'CHARACTER'").select(F.col("id").alias("a"))
    ally = settle(edges.filter("relation = 'ALLIES_WITH'").select("src", "dst").distinct())
    foe = edges.filter("relation = 'CONFLICTS_WITH'").select(F.col("src").alias("a"), F.col("dst").alias("c")).distinct().join(chars, "a", "left_semi")
    tri = foe.join(ally.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a").join(ally.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    key = F.array_sort(F.array("a", "b", "c"))
    return tri.groupBy(key.alias("members")).agg(F.min(F.struct("a", "b", "c")).alias("t")).select(F.array_join("members", ",").alias("members"), "t.*")


def causal_chains(events: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Backward chains without cycles; emitted at a root cause or at the depth limit."""
    cause = settle(edges.filter("relation = 'CAUSED_BY'").select(F.col("dst").alias("last"), F.col("src").alias("pred")).distinct())
    front = events.select(F.array("id").alias("path"), F.col("id").alias("last"))
    out = None
    for _ in range(depth):
        ended = front.join(cause.select("last"), "last", "left_anti").filter(F.size("path") > 1).select("path")
        out = ended if out is None else out.unionByName(ended)
        front = front.join(cause, "last").filter(~F.array_contains("path", F.col("pred"))).select(F.concat("path", F.array("pred")).alias("path"), F.col("pred").alias("last"))
    out = out.unionByName(front.filter(F.size("path") > 1).select("path"))
    return out.select(F.col("path")[0].alias("event"), F.element_at("path", -1).alias("root_cause"), (F.size("path") - 1).alias("depth"), F.array_join(F.reverse("path"), " led to ").alias("narrative"))


def hidden_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): characters that no edge joins and a walk of two or three edges from the lesser id does, once each.

    Such a walk between unlinked nodes implies a simple path. Only edges that
    can lie on one are shuffled: bitmaps say which nodes are characters
    (``ends``), which have an edge to one (``near``) and which have an edge to
    those (``far``). Hubs are joined in parts, and what is reached is made
    distinct before the last edge. For reports use
    :func:`revealed_connections`, which has a row per character.
    """
    link = edges.select("src", "dst").filter("src <> dst")
    chars = settle(nodes.filter("type = 'CHARACTER'").select("id").distinct())
    ids = marks(chars, "id")
    near = marks(marked(link, "dst", ids, "ends").filter("ends"), "src")
    far = marks(marked(link, "dst", near, "near").filter("near"), "src")
    flagged = link
    for name, key, bits in (("starts", "src", ids), ("ends", "dst", ids), ("near", "dst", near), ("far", "dst", far)):
        flagged = marked(flagged, key, bits, name)
    link = settle(flagged.filter("ends OR near OR (starts AND far)").distinct())
    out, into = link.filter("starts AND (near OR far)"), link.filter("near").select("src", "dst")
    one = out.join(chars.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("src"))
    hubs = grid(heavy(out.select(F.col("dst").alias("src")), "src", HUB_ROWS), heavy(into, "src", HUB_ROWS))
    two = meet(one, into, hubs, "a").filter("a <> dst").select("a", F.col("dst").alias("src"))
    front = settle(one.unionByName(two).distinct())
    last = link.filter("ends").select("src", "dst")
    hubs = grid(heavy(front, "src", HUB_ROWS), heavy(last, "src", HUB_ROWS))
    last = last.join(chars.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    reach = meet(front, last, hubs, "a").select("a", F.col("dst").alias("b")).filter("a < b").distinct()
    direct = link.filter("starts AND ends").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return reach.join(direct, ["a", "b"], "left_anti").select("a", "b")


def revealed_connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_links, least): per character with :func:`hidden_links` their number and the least id at their other end; its size is that of the nodes."""
    pairs = hidden_links(nodes, edges)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"))
    return ends.groupBy("e.id").agg(F.count(F.lit(1)).alias("n_links"), F.min("e.other").alias("least"))


def plot_complications(nodes: DataFrame, edges: DataFrame, tensions: int | None = None) -> DataFrame:
    """Triangles (high), pairs of characters joined only through others (medium), events without consequence (low): (kind, priority, first, second).

    ``tensions`` keeps the first so many triangles by their members; by default all.
    """
    found = conflict_triangles(nodes, edges)
    row = lambda kind, priority, first, second: [F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.col(first).alias("first"), second.alias("second")]
    top = (found if tensions is None else found.orderBy("members").limit(tensions)).select(*row("character_tension", "high", "a", F.col("c")))
    apart = hidden_links(nodes, edges).select(*row("reveal_connection", "medium", "a", F.col("b")))
    acts = edges.filter("src <> dst").select(F.col("src").alias("id")).distinct()
    loose = nodes.filter("type = 'EVENT'").join(acts, "id", "left_anti").select(*row("unresolved_event", "low", "id", F.lit("")))
    return top.unionByName(apart).unionByName(loose)


def causal_inference(events: DataFrame, edges: DataFrame, ahead: int = 4, least: float = 0.5) -> DataFrame:
    """Likely causes among the next ``ahead`` events in (chapter, id) order.

    Input events: id, name, description, chapter. The order is numbered slice by
    slice and cut into blocks that overlap by the look-ahead.
    """
    rows = numbered(events.withColumn("_all", F.lit(0)), ["_all"], ["chapter", "id"])
    place = edges.filter("relation = 'LOCATED_IN'").groupBy(F.col("src").alias("id")).agg(F.min(F.struct("edge_id", "dst")).alias("p")).select("id", F.col("p.dst").alias("place"))
    rows = settle(rows.join(place, "id", "left").drop("_all"))
    later = rows.select((F.explode(F.array(*[F.col("rn") - i for i in range(1, ahead + 1)]))).alias("rn"), F.col("id").alias("effect"), F.col("description").alias("e_text"),
                        F.col("chapter").alias("e_chapter"), F.col("place").alias("e_place"))
    pairs = settle(rows.select("rn", F.col("id").alias("cause"), F.col("name").alias("c_name"), F.col("place").alias("c_place")).join(later, "rn"))
    into = edges.select(F.col("src").alias("actor"), F.col("dst").alias("event")).distinct()
    shared = pairs.select("cause", "effect").join(into.withColumnRenamed("event", "cause"), "cause").join(
        into.withColumnRenamed("event", "effect"), ["effect", "actor"], "left_semi").groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("shared"))
    j = pairs.join(shared, ["cause", "effect"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    score = (F.when(F.contains(F.lower("e_text"), F.lower("c_name")), 0.6).otherwise(0.0) + 0.3 * F.least(F.col("shared"), F.lit(3))
             + F.when(F.col("c_place").eqNullSafe(F.col("e_place")), 0.1).otherwise(0.0))
    return j.withColumn("strength", F.round(score, 6)).filter(F.col("strength") >= least).select(
        "cause", "effect", F.least("strength", F.lit(1.0)).alias("strength"), F.col("e_chapter").alias("chapter"), "shared")


def event_role(df: DataFrame, description: str, action: str, chapter: str, total: str) -> DataFrame:
    """Narrative role by keywords and position; the first role wins ties."""
    text, act = F.lower(description), F.lower(action)
    pos = F.col(chapter) / F.greatest(F.lit(1), F.col(total))
    extra = {"setup": F.when(pos < 0.2, 0.3), "complication": F.when((pos >= 0.2) & (pos < 0.8), 0.2), "reversal": F.when((pos >= 0.2) & (pos < 0.8), 0.1),
             "climax": F.when(pos >= 0.8, 0.3), "resolution": F.when(pos >= 0.8, 0.2)}
    scored = []
    for i, (role, words) in enumerate(lexicons.ROLE_WORDS.items()):
        hits = sum((F.when(text.contains(w) | (act == w), 1).otherwise(0) for w in words), F.lit(0))
        scored.append(F.struct(F.round(hits * 0.5 + F.coalesce(extra[role], F.lit(0.0)), 6).alias("s"), F.lit(-i).alias("o"), F.lit(role).alias("r")))
    best = F.array_max(F.array(*scored))
    out = df.withColumn("_b", best)
    ok = F.col("_b.s") > 0.3
    return out.withColumns({"role": F.when(ok, F.col("_b.r")).otherwise("unknown"), "confidence": F.when(ok, F.least(F.lit(1.0), F.col("_b.s"))).otherwise(0.0)}).drop("_b")


def graph_views(nodes: DataFrame, edges: DataFrame, max_chapter: int | None = None) -> dict[str, DataFrame]:
    """Edge lists of the four views: whole graph, characters, event chain, locations."""
    of = lambda k: nodes.filter(F.col("type") == k).select("id")
    if max_chapter is None:
        full = between(edges, nodes, nodes)
    else:
        full = snapshot(nodes, edges, max_chapter)[1]
    return {"full": full, "characters": between(edges, of("CHARACTER"), of("CHARACTER")), "events": between(edges, of("EVENT"), of("EVENT")),
            "locations": between(edges.filter("relation = 'LOCATED_IN'"), nodes, of("LOCATION"))}
