"""Reports, JSON payloads and pages of small results."""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import error_code, underlined, web_address

#: The error codes that have a hint, in order.
CODES = ("000904", "001003", "001038", "001304", "002002", "002003", "002014", "002043", "090106", "091002", "100035", "100038")
#: What to try, by code; a project's settings may say something else for these and for other codes.
HINTS = {code: f"code {code}: no advice yet; add some under 'hints' in the project's settings" for code in CODES} | {
    "000904": "A column or name is unknown here: compare it with the columns listed by the graph command.",
    "001003": "The text is no statement: look before the place that the message names.",
    "002002": "Look for a value, or an object, that is already taken or too large.",
    "002003": "Look whether what the statement names is there, and who may use it.",
    "002043": "Look whether every expression fits what it is used for.",
    "090106": "Name the schema, or put USE SCHEMA above; then look at the grants.",
}
#: Lines of a message that say where code of the engine was, not what is wrong.
NOISE = (r"^\s*at [\w.$]+\(", r"^\s*File \"", r"^Traceback \(", r"^\s*\^+\s*$", r"^JVM stacktrace:", r"^== SQL ", r"^\s*$", r"Py4JJavaError", r"^\t")
#: Caps of reports.
SAMPLES, SQL_LINES, MESSAGE_LINES, BLOCKED = 5, 10, 6, 8
#: Caps of what is handed to a helper that suggests fixes, and how many are asked for.
ASKED_SQL, ASKED_ERROR, ASKED = 3000, 1000, 3


def hinted(errors: DataFrame, column: str = "message", hints: dict[str, str] | None = None) -> DataFrame:
    """Adds ``code`` and ``hint`` (null for other codes)."""
    table = F.create_map(*(F.lit(x) for kv in (HINTS | (hints or {})).items() for x in kv))
    return errors.withColumn("code", error_code(F.col(column))).withColumn("hint", F.try_element_at(table, F.col("code")))


def plain_message(message: Column) -> Column:
    """A message without lines of noise; as it is, if nothing else is in it."""
    lines = F.filter(F.split(message, "\n"), lambda x: ~x.rlike("|".join(f"(?:{n})" for n in NOISE)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(message)


def violation_lines(violations: DataFrame) -> DataFrame:
    """Policy violations with a line of carets below the form that is wrong, and the line as it should be."""
    shown = F.upper("source_line")
    fixed = F.regexp_replace("source_line", F.concat(F.lit("(?i)"), F.regexp_replace("found_form", " ", r"\\s+"), F.lit(r"(?=\s)")), F.col("suggested_form"))
    return violations.withColumn("carets", underlined(shown, F.col("found_form"))).withColumn("fixed_line", fixed)


def violations_text(rows: Iterable) -> str:
    """rows: of violations or violation_lines."""
    out, n = [], 0
    for n, r in enumerate(rows, 1):
        line = r["source_line"]
        at = line.upper().find(r["found_form"])
        out += [f"{n}. {r['file_path']}:{r['line_number']}", f"   {r['object_type']} {r['fqn']}: {r['found_form']}, wanted {r['suggested_form']}", f"   | {line}"]
        out += [f"   | {' ' * at}{'^' * len(r['found_form'])}", f"   + {line[:at]}{r['suggested_form']}{line[at + len(r['found_form']) :]}"] if at >= 0 else []
    return "\n".join([*out, f"{n} statements must be CREATE OR ALTER"])


def preview(sql: str, most: int = SQL_LINES) -> list[str]:
    lines = sql.strip().splitlines()
    shown = [f"{i:4} | {x.rstrip()}" for i, x in enumerate(lines[:most], 1)]
    return shown + ([f"     | and {len(lines) - most} more"] if len(lines) > most else [])


def failures_text(errors: DataFrame, hints: dict[str, str] | None = None) -> str:
    """errors: (fqn, object_type, file_path, sql, message, blocked array). One part for each failure, what it blocks, and the total."""
    told = hinted(errors.withColumn("message", plain_message(F.col("message"))), hints=hints).withColumn("address", web_address(F.col("message")))
    out, blocked = [], 0
    for r in told.collect():  # a run's failures
        out.append(f"{r['object_type']} {r['fqn']} ({r['file_path']})")
        out += [f"  {x}" for line in r["message"].splitlines() for x in textwrap.wrap(line, 72, subsequent_indent="  ")][:MESSAGE_LINES]
        out += [f"  hint: {r['hint']}"] if r["hint"] else []
        out += [f"  see {r['address']}"] if r["address"] else []
        out += preview(r["sql"])
        if r["blocked"]:
            more = len(r["blocked"]) - BLOCKED
            out.append(f"  blocks {', '.join(r['blocked'][:BLOCKED])}" + (f" and {more} more" if more > 0 else ""))
        blocked += len(r["blocked"])
    return "\n".join([*out, f"{blocked} blocked in all"])


ERRORS = "fqn string, object_type string, file_path string, sql string, message string, blocked array<string>"


def suggested(errors: list[dict], ask: Callable[[str], str] | None) -> list[str]:
    """What a helper says to the first failures; nothing without one. A helper that fails is left out."""
    out = []
    for e in errors[:ASKED] if ask else []:
        try:
            out.append(ask(f"{e['object_type']} {e['fqn']}\n{e['sql'][:ASKED_SQL]}\n\n{e['message'][:ASKED_ERROR]}"))
        except Exception as problem:
            out.append(f"no suggestion: {problem}")
    return out


def summary(result) -> str:
    return f"{result.deployed} of {result.total} deployed, {result.skipped} skipped, {result.failed} failed in {result.elapsed:.1f} s"


def load_text(done: list) -> str:
    out = [f"{d.status:8} {d.name}  {len(d.columns)} columns, {d.rows} rows" + (f"  {d.error.splitlines()[0]}" if d.error else "") for d in done]
    return "\n".join([*out, f"{len(done)} files, {sum(d.status == 'SUCCESS' for d in done)} loaded, {sum(d.status == 'FAILED' for d in done)} failed"])


def outcomes(results: DataFrame) -> DataFrame:
    """One row: how many checks passed and failed."""
    return results.agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def checks(results: DataFrame) -> str:
    rows = results.orderBy("test_case").collect()  # one row a case
    out = []
    for r in rows:
        out.append(f"{'pass' if r['passed'] else 'FAIL'}  {r['test_case']}" + ("" if r["passed"] else f": {r['message']}"))
        out += [f"      {x}" for x in (r["failing_rows"] or [])[:SAMPLES]]
    passed = sum(r["passed"] for r in rows)
    return "\n".join([*out, f"{passed} passed, {len(rows) - passed} failed"])


def plan_lines(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqn, level, deps): what each object depends on, joined in order."""
    deps = edges.groupBy(F.col("source").alias("fqn")).agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("deps"))
    return levels.join(deps, "fqn", "left")


def plan_text(levels: DataFrame, edges: DataFrame) -> str:
    rows = plan_lines(levels, edges).orderBy("level", "fqn").collect()  # a project's objects
    return "\n".join(f"{i}. {r['fqn']}" + (f" <- {r['deps']}" if r["deps"] else "") for i, r in enumerate(rows, 1))


def _told(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]


OBJECT = ("fqn", "object_type", "file_path", "dependencies", "columns", "checksum")


def plan_json(objects: DataFrame, order: list[str]) -> str:
    at = {x: i for i, x in enumerate(order)}
    rows = sorted(_told(objects.select(*OBJECT)), key=lambda r: at[r["fqn"]])
    return json.dumps({"objects": rows, "total": len(rows)}, indent=2)


def graph_json(objects: DataFrame, edges: DataFrame, order: list[str], violations: list) -> str:
    """The whole graph: nodes in order, edges (source, target, type, object_type), types and columns by name."""
    at = {x: i for i, x in enumerate(order)}
    parts = F.split("fqn", r"\.")
    schema = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("").alias("schema")
    nodes = _told(objects.select("fqn", "object_type", "file_path", schema, F.element_at(parts, -1).alias("name"), "columns", "dependencies"))
    nodes.sort(key=lambda r: at[r["fqn"]])
    types, columns = ({n["fqn"]: n[k] for n in nodes if n[k]} for k in ("object_type", "columns"))
    told = [f"{v['file_path']}:{v['line_number']}: {v['fqn']}: {v['found_form']}, wanted {v['suggested_form']}" for v in violations]
    return json.dumps({"nodes": nodes, "edges": _told(edges.select("source", "target", "type", "object_type")), "node_types": types, "node_columns": columns, "violations": told}, indent=2)


def lineage_json(nodes: DataFrame, edges: DataFrame, focus: str | None = None, depth: int | None = None, direction: str | None = None, truncated: bool = False) -> str:
    """A graph or the part of it around ``focus``."""
    shown = nodes.select("fqn", "object_type", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("columns", F.array().cast("array<struct<name:string,type:string>>")).alias("columns"))
    return json.dumps({"focus": focus, "depth": depth, "direction": direction, "nodes": _told(shown.orderBy("fqn")), "edges": _told(edges.select("source", "target", "type", "object_type")), "truncated": truncated})


def load_json(done: list, schema: str) -> str:
    files = [{"fqn": d.name, "file_path": d.path, "table_name": d.name.split(".")[-1], "schema": schema, "columns": d.columns, "column_types": d.types, "row_count": d.rows, "checksum": d.checksum} for d in done if d.status != "FAILED"]
    return json.dumps({"files": files, "warnings": [f"{d.path}: {d.error}" for d in done if d.status == "FAILED"]}, indent=2)


def resources_json(found: DataFrame, database: str) -> str:
    return json.dumps({"database": database, "resources": _told(found)}, indent=2)


def page(nodes: DataFrame, edges: DataFrame, layers: DataFrame, title: str = "Lineage") -> str:
    """A page that draws the graph in layers, with a search, a filter by kind and what is said about a node when it is clicked.

    edges: in the direction of data. The places are computed here, so that the page only draws.
    """
    shown = _told(nodes.select("fqn", "object_type", *(c for c in ("file_path", "columns") if c in nodes.columns)).join(layers.select("fqn", "layer"), "fqn", "left").orderBy("fqn"))
    rows: dict[int, int] = {}
    for n in shown:
        layer = n.pop("layer") or 0
        n["x"], n["y"] = layer, rows.get(layer, 0)
        rows[layer] = n["y"] + 1
    payload = json.dumps({"nodes": shown, "edges": _told(edges.select("source", "target", "type"))}).replace("</", "<\\/")
    return PAGE.replace("TITLE", html.escape(title)).replace("PAYLOAD", payload)


PAGE = """<!doctype html><meta charset=utf-8><title>TITLE</title>
<style>body{font:13px sans-serif;margin:8px}rect{fill:#eef;stroke:#557}.off{opacity:.12}path{fill:none;stroke:#888}.reads{stroke:#27a}.writes{stroke:#a52}#said{white-space:pre}</style>
<h1>TITLE</h1><input id=q placeholder=Search> <select id=k><option value="">every kind</option></select> <span id=n></span><div id=said></div><svg id=s></svg>
<script>
const g=PAYLOAD,W=230,H=34,NS='http://www.w3.org/2000/svg',$=i=>document.getElementById(i),at={};
const make=(n,a,p)=>{const e=document.createElementNS(NS,n);for(const k in a)e.setAttribute(k,a[k]);p.append(e);return e};
const s=$('s');s.setAttribute('width',W*(1+Math.max(0,...g.nodes.map(n=>n.x))));s.setAttribute('height',H*(2+Math.max(0,...g.nodes.map(n=>n.y))));
g.nodes.forEach(n=>at[n.fqn]=n);
const drawn=g.edges.filter(e=>at[e.source]&&at[e.target]).map(e=>{const a=at[e.source],b=at[e.target],x=a.x*W+200,y=a.y*H+15,u=b.x*W+5,v=b.y*H+15;
 return [e,make('path',{class:e.type,d:`M${x} ${y}C${x+30} ${y} ${u-30} ${v} ${u} ${v}`},s)]});
const boxes=g.nodes.map(n=>{const b=make('g',{transform:`translate(${n.x*W+5},${n.y*H+3})`},s);make('rect',{width:195,height:24,rx:4},b);make('text',{x:6,y:16},b).textContent=n.fqn.slice(0,30);
 make('title',{},b).textContent=n.fqn;b.onclick=()=>$('said').textContent=[n.object_type+' '+n.fqn,n.file_path||'',...(n.columns||[]).map(c=>'  '+c.name+' '+c.type)].join('\\n');return [n,b]});
[...new Set(g.nodes.map(n=>n.object_type))].sort().forEach(k=>{const o=document.createElement('option');o.textContent=o.value=k;$('k').append(o)});
const show=()=>{const q=$('q').value.toUpperCase(),k=$('k').value,hit=new Set(g.nodes.filter(n=>(!k||n.object_type==k)&&n.fqn.includes(q)).map(n=>n.fqn)),near=new Set(hit);
 if(q||k)g.edges.forEach(e=>{if(hit.has(e.source))near.add(e.target);if(hit.has(e.target))near.add(e.source)});
 boxes.forEach(([n,b])=>b.setAttribute('class',near.has(n.fqn)?'':'off'));drawn.forEach(([e,p])=>p.setAttribute('class',e.type+(hit.has(e.source)||hit.has(e.target)?'':' off')));
 $('n').textContent=`${hit.size} of ${g.nodes.length} nodes, ${g.edges.length} edges`};
$('q').oninput=$('k').onchange=show;show()
</script>"""
