"""Graphs of objects as edge tables (source depends on target).

Every algorithm is a loop of equi-joins on the frontier. A round writes what it
has found and nothing else; earlier rounds are read from their files, which go
when the loop ends. Nothing is gathered on the driver but whether a round found
anything. A loop takes as many rounds as the longest path has edges.

A project's graph is small: up to ``small`` edges, the driver does the same in
memory, as a round would take longer than all of it. Results do not differ.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Rounds, settled


#: Edges, and vertices, up to which the driver works in memory.
SMALL = 50_000


def gathered(rows: DataFrame, most: int) -> list[tuple] | None:
    """The distinct rows, if there are at most so many."""
    found = rows.distinct().limit(most + 1).collect() if most else None
    return None if found is None or len(found) > most else [tuple(r) for r in found]


def _made(rows: list[tuple], like: DataFrame, schema: str) -> DataFrame:
    """A table whose first column has the type of ``like``'s."""
    return like.sparkSession.createDataFrame(rows, schema.replace("?", like.schema[0].dataType.simpleString()))


def _reached(steps: dict, start: set) -> set:
    """What can be reached from ``start`` in a step or more."""
    seen, frontier = set(), start
    while frontier:
        frontier = {y for x in frontier for y in steps.get(x, ())} - seen
        seen |= frontier
    return seen


def _steps(pairs: list[tuple]) -> dict:
    out: dict = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    return out


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct (source, target) between known vertices, without loops."""
    names = vertices.select(F.col("fqn").alias("target"))
    return edges.where("source <> target").select("source", "target").distinct().join(names, "target", "left_semi").join(names.withColumnRenamed("target", "source"), "source", "left_semi").select("source", "target")


def all_edges(objects: DataFrame, lineage: DataFrame) -> DataFrame:
    """Bag of typed edges: dependency, reads, writes."""
    deps = objects.select(F.col("fqn").alias("source"), F.explode("dependencies").alias("target"), F.lit("dependency").alias("type"), "object_type")
    deps = deps.join(objects.select(F.col("fqn").alias("target")), "target", "left_semi").where("source <> target").select("source", "target", "type", "object_type")
    kinds = objects.select(F.col("fqn").alias("object_fqn"), "object_type")
    named = lineage.join(kinds, "object_fqn", "left").withColumn("object_type", F.coalesce("object_type", F.lit("EXTERNAL")))
    side = lambda column, kind: named.select(F.col("object_fqn").alias("source"), F.explode(column).alias("target"), F.lit(kind).alias("type"), "object_type")
    return deps.unionByName(side("sources", "reads")).unionByName(side("targets", "writes"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("vertex")).agg(F.count("*").alias("n"))


def reverse_index(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("ref")).agg(F.array_sort(F.collect_set("source")).alias("objects"))


def topo_levels(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(fqn, level): level 0 depends on nothing; vertices on or behind a cycle have a null level.

    A vertex is ready once as many of its dependencies are done as it has; each
    round counts those that the last round's vertices settle.
    """
    every = vertices.select("fqn").distinct()
    pairs = gathered(edges.select("source", "target"), small)
    names = gathered(every, small) if pairs is not None else None
    if names is not None:
        return _made(_levels({x for (x,) in names}, pairs), every, "fqn ?, level int")
    steps = settled(edges.select("source", "target").distinct())
    needs = settled(steps.groupBy("source").agg(F.count("*").alias("needs")))
    done, arrived, level = Rounds(), Rounds(), 0
    ready = done.add(every.join(needs.select(F.col("source").alias("fqn")), "fqn", "left_anti").withColumn("level", F.lit(0)))
    while not ready.isEmpty():
        level += 1
        new = arrived.add(steps.join(ready.select(F.col("fqn").alias("target")), "target").groupBy("source").agg(F.count("*").alias("n")))
        so_far = arrived.all().join(new.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("n").alias("n"))
        now = so_far.join(needs, "source").where("n = needs").select(F.col("source").alias("fqn"), F.lit(level).alias("level"))
        ready = done.add(now.join(every, "fqn", "left_semi"))
    rest = every.join(done.all().select("fqn"), "fqn", "left_anti").withColumn("level", F.lit(None).cast("int"))
    return done.result(done.all().union(rest), arrived)


def _levels(names: set, pairs: list[tuple]) -> list[tuple]:
    left: dict = defaultdict(int)
    for source, _ in pairs:
        left[source] += 1
    users, out, level = _steps([(b, a) for a, b in pairs]), {}, 0
    ready = [x for x in names if not left[x]]
    while ready:
        out |= dict.fromkeys(ready, level)
        level, last, ready = level + 1, ready, []
        for x in last:
            for user in users.get(x, ()):
                left[user] -= 1
                if not left[user] and user in names:
                    ready.append(user)
    return [(x, out.get(x)) for x in names]


def cycle_residue(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    return topo_levels(vertices, edges, small).where("level is null").select("fqn")


def on_cycles(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The residue without what merely leads to a cycle: peeled from the other end too."""
    rest = cycle_residue(vertices, edges, small)
    inner = known_edges(edges, rest)
    return cycle_residue(rest, inner.select(F.col("target").alias("source"), F.col("source").alias("target")), small)


def cycle_witness(vertices: DataFrame, edges: DataFrame) -> list[str]:
    """One cycle as a path, by a walk that asks for one edge at a time; empty without one."""
    ring = on_cycles(vertices, edges)
    first = ring.orderBy("fqn").first()
    if first is None:
        return []
    inner, path = settled(known_edges(edges, ring)), [first["fqn"]]
    while True:
        step = inner.where(F.col("source") == path[-1]).agg(F.min("target")).first()[0]
        path.append(step)
        if step in path[:-1]:
            return path[path.index(step) :]


def closure(edges: DataFrame, start: DataFrame, *, dependents: bool = True, small: int = SMALL) -> DataFrame:
    """(vertex) all that (transitively) depend on ``start``, or that it depends on; starts only if on a cycle."""
    near, far = ("target", "source") if dependents else ("source", "target")
    pairs = gathered(edges.select(near, far), small)
    starts = gathered(start.select(start.columns[0]), small) if pairs is not None else None
    if starts is not None:
        return _made([(x,) for x in _reached(_steps(pairs), {x for (x,) in starts})], edges.select(far), "vertex ?")
    steps = settled(edges.select(F.col(near).alias("at"), F.col(far).alias("vertex")).distinct())
    frontier, seen = start.select(F.col(start.columns[0]).alias("at")).distinct(), Rounds()
    while True:
        found = frontier.join(steps, "at").select("vertex").distinct()
        found = seen.add(found.join(seen.all(), "vertex", "left_anti") if seen.paths else found)
        if found.isEmpty():
            return seen.result()
        frontier = found.withColumnRenamed("vertex", "at")


def subgraph(vertices: DataFrame, dependencies: DataFrame, lineage_edges: DataFrame, focus: str, depth: int, direction: str, small: int = SMALL) -> tuple[DataFrame, DataFrame, bool] | None:
    """(nodes, edges, truncated) within ``depth`` hops. Up follows dependencies and all a node's lineage; down the reverse."""
    if depth < 1 or direction not in ("up", "down", "both"):
        raise ValueError("depth must be at least 1, and direction up, down or both")
    spark, focus = vertices.sparkSession, focus.upper()
    if vertices.where(F.col("fqn") == focus).isEmpty():
        return None
    both = dependencies.select("source", "target").union(lineage_edges.select("source", "target"))
    ways = []
    if direction in ("up", "both"):
        ways.append(both.select(F.col("source").alias("at"), F.col("target").alias("vertex")))
    if direction in ("down", "both"):
        ways.append(both.select(F.col("target").alias("at"), F.col("source").alias("vertex")))
    steps = (ways[0] if len(ways) == 1 else ways[0].union(ways[1])).distinct()
    pairs = gathered(steps, small)
    if pairs is not None:
        near, seen_names, last = _steps(pairs), {focus}, {focus}
        for _ in range(depth):
            last = {y for x in last for y in near.get(x, ())} - seen_names
            seen_names |= last
        frontier, seen = (spark.createDataFrame([(x,) for x in some], "vertex string") for some in (last, seen_names))
    else:
        frontier = spark.createDataFrame([(focus,)], "vertex string")
        rounds = Rounds()
        rounds.add(frontier)
        for _ in range(depth):
            found = frontier.select(F.col("vertex").alias("at")).join(steps, "at").select("vertex").distinct()
            frontier = rounds.add(found.join(rounds.all(), "vertex", "left_anti"))
            if frontier.isEmpty():
                break
        frontier = settled(frontier)
        seen = rounds.result()
    beyond = []
    if direction in ("up", "both"):
        beyond.append(dependencies.select(F.col("source").alias("at"), F.col("target").alias("vertex")))
    if direction in ("down", "both"):
        beyond.append(dependencies.select(F.col("target").alias("at"), F.col("source").alias("vertex")))
    truncated = any(not frontier.select(F.col("vertex").alias("at")).join(b, "at").join(seen, "vertex", "left_anti").isEmpty() for b in beyond)
    known = vertices.withColumnRenamed("fqn", "vertex")
    more = [c for c in ("file_path", "columns") if c in vertices.columns]
    nodes = seen.join(known, "vertex", "left").select(F.col("vertex").alias("fqn"), F.coalesce("object_type", F.lit("EXTERNAL")).alias("object_type"), *more)
    every = dependencies.select("source", "target", F.lit("dependency").alias("type")).union(lineage_edges.select("source", "target", "type"))
    edges = every.join(seen.withColumnRenamed("vertex", "source"), "source", "left_semi").join(seen.withColumnRenamed("vertex", "target"), "target", "left_semi").distinct()
    typed = edges.join(vertices.select(F.col("fqn").alias("source"), "object_type"), "source", "left")
    return nodes.orderBy("fqn"), typed.select("source", "target", "type", F.coalesce("object_type", F.lit("UNKNOWN")).alias("object_type")), truncated


def layers(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(fqn, layer): longest path from a vertex without dependencies; 0 on and behind cycles."""
    return topo_levels(vertices, edges, small).select("fqn", F.coalesce("level", F.lit(0)).alias("layer"))


def data_flow(edges: DataFrame) -> DataFrame:
    """Edges in the direction of data: dependency and reads turned round."""
    turned = F.lower("type").isin("dependency", "reads")
    return edges.select(F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"), F.lower("type").alias("type"))


def node_types(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(fqn, object_type) of all ends of edges: as known, else as an edge's source tells, else EXTERNAL."""
    ends = edges.select(F.col("source").alias("fqn")).union(edges.select("target")).distinct()
    told = edges.groupBy(F.col("source").alias("fqn")).agg(F.max("object_type").alias("told"))
    return ends.join(known.select("fqn", F.col("object_type").alias("known")), "fqn", "left").join(told, "fqn", "left").select("fqn", F.coalesce("known", "told", F.lit("EXTERNAL")).alias("object_type"))


def external(objects: DataFrame) -> DataFrame:
    """(fqn, file_path, target): dependencies on what no file of the project defines."""
    named = objects.select("fqn", "file_path", F.explode("dependencies").alias("target"))
    return named.join(objects.select(F.col("fqn").alias("target")), "target", "left_anti").select("fqn", "file_path", "target")


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row: how many nodes, edges, reads and writes."""
    kind = F.lower("type")
    ends = edges.select(F.posexplode(F.array("source", "target")).alias("end", "fqn"), kind.alias("kind"))
    first = F.col("end") == 0
    return ends.agg(
        F.countDistinct("fqn").alias("n_nodes"), F.count_if(first).alias("n_edges"),
        F.count_if(first & (F.col("kind") == "reads")).alias("n_reads"), F.count_if(first & (F.col("kind") == "writes")).alias("n_writes"),
    )


def badges(edges: DataFrame) -> DataFrame:
    """(fqn, n_reads, n_writes) of every object that reads or writes."""
    kind = F.lower("type")
    return edges.where(kind.isin("reads", "writes")).groupBy(F.col("source").alias("fqn")).agg(F.count_if(kind == "reads").alias("n_reads"), F.count_if(kind == "writes").alias("n_writes"))


def view(nodes: DataFrame, edges: DataFrame, *, node_types: list[str] | None = None, edge_types: list[str] | None = None, search: str = "") -> tuple[DataFrame, DataFrame]:
    """The part of a graph that filters leave: nodes of some types, edges of some types; what a search finds, and its direct neighbours."""
    nodes = settled(nodes.where(F.col("object_type").isin(node_types)) if node_types is not None else nodes)
    edges = edges.where(F.lower("type").isin([t.lower() for t in edge_types])) if edge_types is not None else edges
    names = nodes.select("fqn")
    inner = settled(edges.join(names.withColumnRenamed("fqn", "source"), "source", "left_semi").join(names.withColumnRenamed("fqn", "target"), "target", "left_semi"))
    if search:
        hit = names.where(F.contains(F.upper("fqn"), F.lit(search.upper())))
        touched = inner.join(hit.withColumnRenamed("fqn", "source"), "source", "left_semi").union(inner.join(hit.withColumnRenamed("fqn", "target"), "target", "left_semi").select(*inner.columns))
        near = hit.union(touched.select("source")).union(touched.select("target")).distinct()
        return nodes.join(near, "fqn", "left_semi"), touched.distinct().select(*edges.columns)
    return nodes, inner.select(*edges.columns)


def picked(objects: DataFrame, part: str, most: int = 50) -> DataFrame:
    """The first names, in order, that contain a text in any case: a list to pick from."""
    return objects.where(F.contains(F.upper("fqn"), F.lit(part.upper()))).orderBy("fqn").limit(most)
