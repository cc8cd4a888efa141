"""Deploying a project: what changed, and all that depends on it, in order."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import error_code
from ..operators import extract, graph, state
from ..operators.lineage import lineage
from ..operators.tables import settled
from ..sources.project import declared_lineage, read_corpus
from . import dialect
from .catalog import missing


class PolicyError(ValueError):
    """Objects that must be CREATE OR ALTER and are not; ``rows`` has them."""

    def __init__(self, rows: list):
        super().__init__("; ".join(f"{r['fqn']}: {r['found_form']}, wanted {r['suggested_form']}" for r in rows[:20]))
        self.rows = rows


class CycleError(ValueError):
    pass


@dataclass
class Plan:
    objects: DataFrame
    edges: DataFrame
    lineage: DataFrame | None
    order: list[str]
    drops: DataFrame
    levels: DataFrame
    violations: list


@dataclass
class Result:
    total: int = 0
    deployed: int = 0
    skipped: int = 0
    failed: int = 0
    errors: list[dict] = field(default_factory=list)
    execution_order: list[str] = field(default_factory=list)
    elapsed: float = 0.0

    @property
    def blocked(self) -> int:
        return sum(len(e["blocked"]) for e in self.errors)


def plan(spark: SparkSession, folder: str, variables: dict[str, str] | None = None, *, check_policy: bool = True, with_lineage: bool = True, cache: str | None = None) -> Plan:
    """Reads and orders a project. cache: a folder for parsed files, so that only changed ones are parsed again."""
    corpus = read_corpus(spark, folder)
    found = extract.cached_objects(corpus, variables, cache) if cache else settled(extract.objects(corpus, variables))
    bad = extract.violations(found).orderBy("file_path", "line_number").collect()  # a project's objects
    if check_policy and bad:
        raise PolicyError(bad)
    objects = settled(extract.current(found))
    edges = settled(graph.known_edges(objects.select(F.col("fqn").alias("source"), F.explode("dependencies").alias("target")), objects))
    levels = graph.topo_levels(objects, edges)
    if not levels.where("level is null").isEmpty():
        raise CycleError(" -> ".join(graph.cycle_witness(objects, edges)))
    # The names of a project's objects: the driver runs their statements one by one.
    order = [r["fqn"] for r in levels.orderBy("level", "fqn").select("fqn").collect()]
    told = lineage(found, declared_lineage(spark, folder)) if with_lineage else None
    return Plan(objects, edges, told, order, found.where("is_drop"), levels, bad)


def selected(project: Plan, store: state.Store, spark: SparkSession, *, force: bool = False, target: str | None = None) -> set[str]:
    """What is to run: a target and its dependents; or changed and missing objects and theirs; or all."""
    if force:
        return set(project.order)
    if target is not None:
        start = spark.createDataFrame([(target.upper(),)], "fqn string")
    else:
        last = state.latest_success(store.read("deploy_history").where("object_type <> 'DATA'")).select("object_fqn", "checksum")
        start = state.changed(project.objects.select("fqn", "checksum"), last).select("fqn").union(missing(spark, project.objects)).distinct()
        start = settled(start)
    return {r[0] for r in start.union(graph.closure(project.edges, start)).distinct().collect()}


def typed_edges(project: Plan) -> DataFrame:
    """All edges with the file and the description of their source."""
    edges = graph.all_edges(project.objects, project.lineage)
    edges = edges.join(project.objects.select(F.col("fqn").alias("source"), "file_path"), "source", "left")
    told = project.lineage.groupBy(F.col("object_fqn").alias("source")).agg(F.max("description").alias("description"))
    return edges.join(told, "source", "left")


def deploy(spark: SparkSession, folder: str, variables: dict[str, str] | None = None, *, store: state.Store | None = None, dry_run: bool = False, force: bool = False, target: str | None = None, cache: str | None = None) -> Result:
    """Runs what is to run, in order. What depends on a failure is blocked: it counts as failed and as skipped, and stands at the failure."""
    began, result = time.time(), Result()
    project = plan(spark, folder, variables, cache=cache)
    result.total = len(project.order)
    if target is not None and target.upper() not in project.order:
        result.failed, result.errors = 1, [_failure(target.upper(), "", "", "", f"target '{target}' not found")]
        return result
    if dry_run:
        result.deployed, result.execution_order = len(project.order), project.order
        return result
    store = store or state.Store(spark)
    store.snapshot(typed_edges(project))
    chosen = selected(project, store, spark, force=force, target=target)
    wanted = spark.createDataFrame([(x,) for x in sorted(chosen)], "fqn string")
    rows = {r["fqn"]: r for r in project.objects.select("fqn", "object_type", "file_path", "script", "checksum", "dependencies").join(wanted, "fqn", "left_semi").collect()}
    roots, done, ran, schema = {}, [], [], spark.catalog.currentDatabase()
    for fqn in project.order:
        if fqn not in chosen:
            result.skipped += 1
            continue
        row = rows[fqn]
        blockers = sorted(set(row["dependencies"]) & set(roots))
        status, error = "SUCCESS", None
        if blockers:
            status, error = "SKIPPED", f"blocked by {', '.join(blockers)}"
            roots[fqn] = roots[blockers[0]]
            roots[fqn]["blocked"].append(fqn)
            result.failed, result.skipped = result.failed + 1, result.skipped + 1
        else:
            try:
                dialect.execute(spark, row["script"])
                result.deployed += 1
                result.execution_order.append(fqn)
                done.append((fqn, row["object_type"], row["file_path"]))
            except Exception as e:
                status, error = "FAILED", str(e)
                result.failed += 1
                result.errors.append(_failure(fqn, row["object_type"], row["file_path"], row["script"], error))
                roots[fqn] = result.errors[-1]
        ran.append((fqn, row["object_type"], row["file_path"], row["checksum"], status, error, row["script"]))
    if ran:
        store.record(ran)
    _lifecycle(spark, project, store, done)
    spark.catalog.setCurrentDatabase(schema)  # scripts may have used another one
    result.elapsed = time.time() - began
    return result


def _failure(fqn: str, kind: str, path: str, sql: str, message: str) -> dict:
    return {"fqn": fqn, "object_type": kind, "file_path": path, "sql": sql, "message": message, "blocked": []}


def statuses(history: DataFrame) -> DataFrame:
    """(status, n, with_code): counts of a history's records."""
    return history.groupBy("status").agg(F.count("*").alias("n"), F.count(error_code(F.col("error_message"))).alias("with_code"))


def _lifecycle(spark: SparkSession, project: Plan, store: state.Store, done: list[tuple]) -> None:
    now, table = F.current_timestamp(), store.read("object_lifecycle")
    if done:
        table = state.upsert(table, spark.createDataFrame(done, "object_fqn string, object_type string, file_path string"), now)
    active = table.where("status = 'ACTIVE'").select("object_fqn")
    defined = project.objects.select(F.col("fqn").alias("object_fqn"))
    dropped = settled(project.drops.select(F.col("fqn").alias("object_fqn"), "object_type", "script").join(active, "object_fqn", "left_semi").join(defined, "object_fqn", "left_anti").dropDuplicates(["object_fqn"]))
    gone = []
    for row in dropped.collect():  # those that are still active: statements to run
        try:
            dialect.execute(spark, row["script"])
            gone.append((row["object_fqn"],))
        except Exception as e:
            dialect.log.warning("%s was not dropped: %s", row["object_fqn"], e)
    table = state.retire(table, spark.createDataFrame(gone, "object_fqn string"), "DROPPED", now)
    away = state.removed(table, project.objects, project.drops)
    store.replace("object_lifecycle", state.retire(table, away, "REMOVED", now))
