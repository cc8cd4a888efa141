"""Command line: init, plan, deploy, load, graph, lineage, test, resources, history, apps."""

from __future__ import annotations

import argparse
import functools
import json
import logging
import os
import sys
from pathlib import Path

SCAFFOLD = {
    "declara.yml": "objects-folder: objects\ndata-folder: data\ndata-schema: public\nvariables: {}\n",
    "objects/schemas/public.sql": "CREATE OR ALTER SCHEMA public;\n",
    "objects/tables/samples.sql": "USE SCHEMA public;\nCREATE OR ALTER TABLE samples (id NUMBER(10,0) NOT NULL, name VARCHAR(100));\n",
    "objects/views/named_samples.sql": "USE SCHEMA public;\nCREATE OR ALTER VIEW named_samples AS SELECT id, name FROM samples WHERE name IS NOT NULL;\n",
    "data/kinds.csv": "code,name\nA,first\nB,second\n",
    "data/kinds.yml": "columns:\n  code: VARCHAR(1)\ntests:\n  - name: codes are unique\n    test: unique\n    column: code\n",
}


def settings(args: argparse.Namespace) -> dict:
    """The file's settings, overridden by DECLARA_* variables, then by options."""
    import yaml

    path = Path(args.config)
    told = (yaml.safe_load(path.read_text()) if path.exists() else None) or {}
    told |= {k[8:].lower().replace("_", "-"): v for k, v in os.environ.items() if k.startswith("DECLARA_")}
    told |= {k.replace("_", "-"): v for k, v in vars(args).items() if v is not None and k in ("objects_folder", "data_folder", "data_schema", "cache")}
    given = told.get("variables") or {}
    told["variables"] = (json.loads(given) if isinstance(given, str) else given) | (json.loads(args.vars) if args.vars else {})
    told = {"objects-folder": "objects", "data-folder": "data", "data-schema": "public"} | told
    for k in ("objects-folder", "data-folder", "cache"):  # Spark may run in another folder
        if told.get(k) and ":" not in told[k]:
            told[k] = str(Path(told[k]).absolute())
    return told


def cases(folder: str, only: str | None = None) -> list:
    import yaml

    from .operators.quality import Case

    out = []
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yml", ".yaml")):
        if only and path.stem != only:
            continue
        for i, t in enumerate((yaml.safe_load(path.read_text()) or {}).get("tests") or []):
            named = lambda n: n if n.endswith(".csv") else f"{n}.csv"
            out.append(Case(t.get("name") or f"{path.stem}-{i + 1}", named(t.get("source") or path.stem), t.get("test", ""), t.get("column"), [str(v) for v in t.get("values") or []], t.get("min"), t.get("max"), named(t["to"]) if t.get("to") else None, t.get("to_column"), t.get("expression")))
    return out


def clashes(folder: str) -> list[str]:
    """Stems that two CSV files share, or that other kinds of files have."""
    groups: dict[str, list[str]] = {}
    for p in Path(folder).iterdir():
        groups.setdefault(p.stem, []).append(p.suffix)
    return sorted(s for s, kinds in groups.items() if kinds.count(".csv") > 1 or set(kinds) - {".csv", ".yml", ".yaml"})


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="declara")
    parser.add_argument("command", choices=["init", "plan", "deploy", "load", "graph", "lineage", "test", "resources", "history", "apps"])
    parser.add_argument("name", nargs="?")
    parser.add_argument("--config", default="declara.yml")
    parser.add_argument("--objects-folder")
    parser.add_argument("--data-folder")
    parser.add_argument("--data-schema")
    parser.add_argument("--vars", help="JSON of variables")
    parser.add_argument("--cache", help="folder for parsed files")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--target", help="this object and all that depends on it")
    parser.add_argument("--local", action="store_true", help="lineage of the files, not of the last deployment")
    parser.add_argument("--object")
    parser.add_argument("--depth", type=int, default=1)
    parser.add_argument("--direction", default="both", choices=["up", "down", "both"])
    parser.add_argument("--output", default="lineage.html")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    # Payloads go to standard output, what is logged to the other one.
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING if args.json else logging.INFO, format="%(levelname)s %(message)s")
    if args.command == "init":
        for name, text in SCAFFOLD.items():
            if not (path := Path(name)).exists():
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(text)
        return 0
    if args.command == "lineage" and args.json and not args.local:
        print(json.dumps({"error": "--json needs --local"}))
        return 2
    if args.command == "apps":
        from .sources.apps import apps

        found = apps(args.name or ".")
        print(json.dumps({"apps": found}, indent=2) if args.json else "\n".join(f"{a['name']}  {a['directory']}/{a['main_file']}" for a in found))
        return 0
    conf = settings(args)
    from .session import session

    return COMMANDS[args.command](session(), args, conf)


def _load(spark, args, conf) -> int:
    from .operators import state
    from .plans import load, report

    dry = args.dry_run or args.json
    done = load.load(spark, conf["data-folder"], conf["data-schema"], None if dry else state.Store(spark), force=args.force, dry_run=dry)
    print(report.load_json(done, conf["data-schema"]) if args.json else report.load_text(done))
    return int(any(d.status == "FAILED" for d in done))


def _test(spark, args, conf) -> int:
    from .operators import quality
    from .plans import report
    from .sources.project import csv_table

    if bad := clashes(conf["data-folder"]):
        print("several files share a name: " + ", ".join(bad), file=sys.stderr)
        return 1
    told = cases(conf["data-folder"], args.name)
    if not told:
        print("no tests found")
        return 0

    kept: list = []

    @functools.cache
    def tables(name: str):
        kept.append(csv_table(spark, f"{conf['data-folder']}/{name}").cache())
        return kept[-1]

    results = quality.run(spark, told, tables)
    print(report.checks(results))
    for table in kept:  # another run reads the files anew
        table.unpersist()
    return int(report.outcomes(results).first()["n_failed"] > 0)


def _resources(spark, args, conf) -> int:
    from .plans import catalog, report

    found = catalog.resources(spark).orderBy("schema", "type", "name")
    print(report.resources_json(found, spark.catalog.currentCatalog()) if args.json else "\n".join(f"{r['type']:10} {r['fqn']}" for r in found.collect()))
    return 0


def _history(spark, args, conf) -> int:
    from .operators import state

    for r in state.listing(state.Store(spark).read("deploy_history")).collect():
        print(f"{r['deployed_at']:%Y-%m-%d %H:%M:%S}  {r['status']:8} {r['object_fqn']}")
    return 0


def _deploy(spark, args, conf) -> int:
    from .plans import deploy, report

    try:
        result = deploy.deploy(spark, conf["objects-folder"], conf["variables"], dry_run=args.dry_run, force=args.force, target=args.target, cache=conf.get("cache"))
    except deploy.PolicyError as e:
        print(report.violations_text(e.rows), file=sys.stderr)
        return 1
    except deploy.CycleError as e:
        print(f"objects depend on each other: {e}", file=sys.stderr)
        return 1
    if result.errors:
        print(report.failures_text(spark.createDataFrame(result.errors, report.ERRORS), conf.get("hints")), file=sys.stderr)
    print(report.summary(result))
    return int(result.failed > 0)


def _planned(spark, args, conf) -> int:
    """plan and graph."""
    from .operators import graph
    from .plans import deploy, report

    plan = args.command == "plan"
    try:
        project = deploy.plan(spark, conf["objects-folder"], conf["variables"], check_policy=plan, with_lineage=not plan and not args.json, cache=conf.get("cache"))
    except deploy.PolicyError as e:
        print(report.violations_text(e.rows), file=sys.stderr)
        return 1
    except deploy.CycleError as e:
        print(f"objects depend on each other: {e}", file=sys.stderr)
        return 1
    if plan and args.json:
        print(report.plan_json(project.objects, project.order))
    elif args.json:
        empty = spark.createDataFrame([], "object_fqn string, sources array<string>, targets array<string>")
        print(report.graph_json(project.objects, graph.all_edges(project.objects, empty), project.order, project.violations))
    else:
        if project.violations:
            print(report.violations_text(project.violations))
        print(report.plan_text(project.levels, project.edges))
        for r in graph.external(project.objects).orderBy("fqn", "target").collect():
            print(f"warning: {r['fqn']} needs {r['target']}, which no file defines")
        if not plan:
            for r in project.lineage.orderBy("object_fqn").collect():  # a project's procedures and tasks
                print(f"{r['object_fqn']}: reads {', '.join(r['sources']) or '-'}; writes {', '.join(r['targets']) or '-'}")
    return 0


def _lineage(spark, args, conf) -> int:
    from .operators import graph, state
    from .operators.tables import settled
    from .plans import deploy, report

    focus = args.object.upper() if args.object else None
    if args.local:
        project = deploy.plan(spark, conf["objects-folder"], conf["variables"], check_policy=False, cache=conf.get("cache"))
        known, edges, dependencies = project.objects, settled(graph.all_edges(project.objects, project.lineage)), project.edges
    else:  # as of the last deployment
        store = state.Store(spark)
        known, edges = store.known(), settled(store.lineage())
        dependencies = edges.where("type = 'dependency'").select("source", "target")
    if edges.isEmpty() and not args.json:
        print("no lineage is known")
        return 0
    more = [c for c in ("file_path", "columns") if c in known.columns]
    nodes = graph.node_types(edges, known).join(known.select("fqn", *more), "fqn", "left")
    if args.local:  # objects without edges, too
        nodes = nodes.unionByName(known.select("fqn", "object_type", *more).join(nodes.select("fqn"), "fqn", "left_anti"))
    truncated = False
    if focus:
        told = known.select("fqn", "object_type", *more)
        told = told if args.local else nodes.select("fqn", "object_type", *more)
        part = graph.subgraph(told, dependencies, edges.where("type <> 'dependency'").select("source", "target", "type"), focus, args.depth, args.direction)
        if part is None:
            print(json.dumps({"error": "object not found", "fqn": focus}))
            return 2
        nodes, edges, truncated = part
    if args.json:
        around = (focus, args.depth, args.direction) if focus else (None, None, None)
        print(report.lineage_json(nodes, edges, *around, truncated))
        return 0
    flow = settled(graph.data_flow(edges))
    layers = graph.layers(nodes.select("fqn"), flow.select(flow.target.alias("source"), flow.source.alias("target")))
    Path(args.output).write_text(report.page(nodes, flow, layers))
    print(args.output)
    return 0


COMMANDS = {"load": _load, "test": _test, "resources": _resources, "history": _history, "deploy": _deploy, "plan": _planned, "graph": _planned, "lineage": _lineage}

if __name__ == "__main__":
    sys.exit(main())
