"""Projects from end to end: statements, deployment, loading, listings, reports, the command line, the stream."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from declara import cli
from declara.functions.analysis import told
from declara.operators import extract, graph, quality, state
from declara.operators.lineage import lineage
from declara.plans import catalog, deploy, dialect, load, report
from declara.plans.registry import Registry
from declara.sources.project import declared_lineage, read_corpus, read_csv_strict
from declara.streaming.history import follow


def write(folder, **files):
    for name, text in files.items():
        path = folder / (name.replace("__", "/") + ("" if "." in name else ".sql"))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def by_name(sql, path="f/x.sql"):
    return {o["fqn"]: o for o in told(sql, path)}


def test_objects_of_one_file():
    found = by_name("USE SCHEMA d2.s2; CREATE TABLE t (a INT); CREATE VIEW v AS SELECT * FROM t; CREATE VIEW w AS SELECT * FROM v; INSERT INTO t SELECT 1 FROM x.y;")
    assert {k: o["dependencies"] for k, o in found.items()} == {"S2.T": [], "S2.V": ["S2.T"], "S2.W": ["S2.T", "S2.V", "X.Y"]}
    assert found["S2.V"]["script"] == "USE SCHEMA d2.s2;\nCREATE VIEW v AS SELECT * FROM t;"
    assert by_name("USE DATABASE d; USE SCHEMA s; GRANT SELECT ON ALL TABLES IN SCHEMA a.b TO ROLE r", "f/grants.sql")["D.S.GRANTS"]["dependencies"] == ["A.B"]
    assert by_name("GRANT USAGE ON FILE FORMAT a.f TO ROLE r")["X"]["dependencies"] == ["A.F"]
    both = by_name("CREATE OR REPLACE PROCEDURE a.p() AS $$ SELECT * FROM a.t1 $$; CREATE OR REPLACE PROCEDURE a.q() AS 'INSERT INTO a.o SELECT ''x'' FROM a.t2';")
    assert (both["A.P"]["sources"], both["A.Q"]["sources"], both["A.Q"]["targets"]) == (["A.T1"], ["A.T2"], ["A.O"])
    assert by_name("DROP TABLE IF EXISTS a.b")["A.B"]["is_drop"] and by_name("") == {"X": by_name("")["X"]}
    assert by_name("SELECT 1; DROP VIEW a.b")["X"]["object_type"] == "SCRIPT"


@pytest.mark.parametrize(
    "body, reads, writes",
    [
        ("UPDATE a.o SET s = 'FROM x' WHERE i IN (SELECT i FROM a.p)", ["A.P"], ["A.O"]),
        ("MERGE INTO a.t t USING a.s s ON t.i = s.i WHEN MATCHED THEN UPDATE SET t.v = s.v", ["A.S"], ["A.T"]),
        ("TRUNCATE TABLE a.t; COPY INTO a.r FROM @a.stage/x.csv", [], ["A.R", "A.T"]),
        ("CREATE TEMPORARY TABLE a.snap AS SELECT * FROM a.live, a.more m JOIN (SELECT 1) q", ["A.LIVE", "A.MORE"], ["A.SNAP"]),
        ("INSERT OVERWRITE INTO a.b.c SELECT * FROM dual", [], ["A.B.C"]),
        ("LET r RESULTSET := (SELECT a FROM a.c)", [], []),
        ("SELECT * FROM IDENTIFIER(:x)", [], []),
        ("LET q := 'SELECT * FROM ' || :s", [], []),
        ("RETURN 'ok'", [], []),
    ],
)
def test_bodies(body, reads, writes):
    found = by_name(f"CREATE PROCEDURE a.proc() LANGUAGE SQL AS $$ {body}; $$")["A.PROC"]
    assert (found["sources"], found["targets"]) == (reads, writes)


def test_sidecars(spark, tmp_path):
    folder = write(tmp_path, p="CREATE PROCEDURE a.p() AS $$ INSERT INTO a.o SELECT * FROM a.i $$", q="CREATE PROCEDURE a.q() LANGUAGE JAVA AS $$ x $$")
    (tmp_path / "p.yml").write_text("sources: [ b.x ]\ndescription: why")
    (tmp_path / "q.yaml").write_text("targets: [b.y]")
    found = extract.objects(read_corpus(spark, folder))
    rows = {r["object_fqn"]: (r["sources"], r["targets"], r["description"], r["auto_detected"]) for r in lineage(found, declared_lineage(spark, folder)).collect()}
    assert rows == {"A.P": (["B.X"], ["A.O"], "why", False), "A.Q": ([], ["B.Y"], "", False)}


def test_corpus(spark, tmp_path):
    assert read_corpus(spark, str(tmp_path / "none")).isEmpty()
    write(tmp_path, b__x="SELECT 2", a="SELECT 1", c="")
    assert [r["raw_sql"] for r in read_corpus(spark, str(tmp_path)).collect()][:2] == ["SELECT 1", "SELECT 2"]


def test_cache(spark, tmp_path):
    folder, cache = write(tmp_path / "o", a="CREATE TABLE {{s}}.a (x INT)", b="CREATE TABLE s.b (x INT)"), str(tmp_path / "cache")
    names = lambda v: sorted(r["fqn"] for r in extract.cached_objects(read_corpus(spark, folder), v, cache).collect())
    assert names({"s": "s1"}) == names({"s": "s1"}) == ["S.B", "S1.A"]
    assert names({"s": "s2"}) == ["S.B", "S2.A"]
    write(tmp_path / "o", b="CREATE TABLE s.c (x INT); DROP TABLE s.b")
    assert names({"s": "s2"}) == ["S.B", "S.C", "S2.A"]
    assert [r["line_number"] for r in extract.violations(extract.cached_objects(read_corpus(spark, folder), {"s": "s2"}, cache)).collect()] == [1, 1]


@pytest.fixture
def project(spark, tmp_path):
    name = f"p{abs(hash(str(tmp_path))) % 10**8}"
    folder = write(
        tmp_path / "objects",
        base=f"CREATE OR ALTER SCHEMA {name}; USE SCHEMA {name}; CREATE OR ALTER TABLE base (id NUMBER(10,0), at DATE DEFAULT current_date()); INSERT INTO base (id) VALUES (1); -- @depends_on: {name}\n",
        views=f"USE SCHEMA {name}; CREATE OR ALTER VIEW v AS SELECT id, 'a--b' AS t FROM base; CREATE OR ALTER VIEW w AS SELECT * FROM v QUALIFY ROW_NUMBER() OVER (ORDER BY id) = 1;",
        task=f"CREATE OR ALTER TASK {name}.job AS INSERT INTO {name}.base SELECT * FROM {name}.v; CREATE OR REPLACE FUNCTION {name}.twice(x INT) RETURNS INT AS 'x * 2';",
    )
    yield name, folder, state.Store(spark, f"{name}_state")
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


def test_deploy(spark, project, tmp_path):
    name, folder, store = project
    up = name.upper()
    dry = deploy.deploy(spark, folder, store=store, dry_run=True)
    assert dry.deployed == dry.total == 6 and not spark.catalog.databaseExists(name)
    first = deploy.deploy(spark, folder, store=store)
    assert (first.deployed, first.failed, first.skipped) == (6, 0, 0), [e["message"][:300] for e in first.errors]
    order = first.execution_order
    assert order.index(f"{up}.BASE") < order.index(f"{up}.V") < order.index(f"{up}.W")
    assert spark.sql(f"SELECT t, {name}.twice(21) AS n FROM {name}.w").first() == ("a--b", 42)
    again = deploy.deploy(spark, folder, store=store)
    assert (again.deployed, again.skipped) == (0, 6)
    write(tmp_path / "objects", views=f"USE SCHEMA {name}; CREATE OR ALTER VIEW v AS SELECT id, 'new' AS t FROM base; CREATE OR ALTER VIEW w AS SELECT * FROM v;")
    assert set(deploy.deploy(spark, folder, store=store).execution_order) == {f"{up}.V", f"{up}.W", f"{up}.JOB"}
    target = deploy.deploy(spark, folder, store=store, target=f"{name}.v")
    assert set(target.execution_order) == {f"{up}.V", f"{up}.W", f"{up}.JOB"}  # with its dependents, not with what it needs
    assert deploy.deploy(spark, folder, store=store, target="no.such").failed == 1
    spark.sql(f"DROP VIEW {name}.w")
    assert deploy.deploy(spark, folder, store=store).execution_order == [f"{up}.W"]
    edges = {(r["source"], r["target"], r["type"]) for r in store.lineage().collect()}
    assert (f"{up}.JOB", f"{up}.V", "reads") in edges and (f"{up}.V", f"{up}.BASE", "dependency") in edges
    assert {r["type"] for r in catalog.resources(spark).where(F.col("schema") == name).collect()} >= {"SCHEMA", "TABLE", "VIEW", "FUNCTION", "TASK"}
    write(tmp_path / "objects", views=f"DROP VIEW IF EXISTS {name}.w; CREATE OR ALTER VIEW {name}.v AS SELECT 1 AS id;", task="SELECT 1")
    deploy.deploy(spark, folder, store=store)
    status = {r["object_fqn"]: (r["status"], r["retired_reason"]) for r in store.read("object_lifecycle").collect()}
    assert status[f"{up}.W"] == ("RETIRED", "DROPPED") and status[f"{up}.JOB"] == ("RETIRED", "REMOVED") and status[f"{up}.V"] == ("ACTIVE", None)
    assert not spark.catalog.tableExists(f"{name}.w")


def test_failures_block(spark, tmp_path):
    folder = write(tmp_path, a="CREATE OR ALTER VIEW default.bad AS SELECT * FROM nowhere.at_all", b="CREATE OR ALTER VIEW default.c1 AS SELECT * FROM default.bad", c="CREATE OR ALTER VIEW default.c2 AS SELECT * FROM default.c1", d="CREATE OR ALTER VIEW default.fine AS SELECT 1 AS x")
    store = state.Store(spark, "blocked_state")
    done = deploy.deploy(spark, folder, store=store)
    assert (done.deployed, done.failed, done.skipped, done.blocked) == (1, 3, 2, 2) and done.errors[0]["blocked"] == ["DEFAULT.C1", "DEFAULT.C2"]
    text = report.failures_text(spark.createDataFrame(done.errors, report.ERRORS))
    assert "VIEW DEFAULT.BAD" in text and "blocks DEFAULT.C1, DEFAULT.C2" in text and text.endswith("2 blocked in all")
    counts = {r["status"]: r["n"] for r in deploy.statuses(store.read("deploy_history")).collect()}
    assert counts == {"SUCCESS": 1, "FAILED": 1, "SKIPPED": 2}
    assert report.suggested(done.errors, None) == [] and report.suggested(done.errors, lambda p: p[:4]) == ["VIEW"]


def test_policy_and_cycles(spark, tmp_path):
    folder = write(tmp_path / "p", a="-- first\n  create or replace table x.t (a INT);")
    with pytest.raises(deploy.PolicyError) as e:
        deploy.plan(spark, folder)
    text = report.violations_text(e.value.rows)
    assert "a.sql:2" in text and "   |   ^^^^^^^^^^^^^^^^^" in text and "+   CREATE OR ALTER table x.t" in text
    folder = write(tmp_path / "c", a="CREATE OR ALTER VIEW x.a AS SELECT * FROM x.b", b="CREATE OR ALTER VIEW x.b AS SELECT * FROM x.a")
    with pytest.raises(deploy.CycleError):
        deploy.plan(spark, folder)


def test_statements_on_tables(spark, tmp_path):
    run = lambda sql, params=None: dialect.execute(spark, sql, params)
    run("DROP TABLE IF EXISTS default.tt; CREATE OR ALTER TABLE tt (id INT, v VARCHAR(9) DEFAULT 'd'); INSERT INTO tt VALUES (1, 'x/*y*/z'), (2, 'a--b'); INSERT INTO tt (id) VALUES (3)")
    rows = lambda: sorted(tuple(r) for r in spark.table("default.tt").select("ID", "V").collect())
    assert rows() == [(1, "x/*y*/z"), (2, "a--b"), (3, "d")]
    run("UPDATE tt SET v = 'it''s; ' || v WHERE id = %s", None) if False else run("UPDATE tt SET v = 'it''s; ' || v WHERE id = 2")
    run("DELETE FROM tt t WHERE t.id = 3 OR t.v IS NULL")
    assert rows() == [(1, "x/*y*/z"), (2, "it's; a--b")]
    run("MERGE INTO tt USING (SELECT * FROM VALUES (1, 'm'), (9, 'n') AS s(id, v)) s ON tt.id = s.id WHEN MATCHED AND CASE WHEN s.v = 'm' THEN true END THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT VALUES (s.id, s.v)")
    assert rows() == [(1, "m"), (2, "it's; a--b"), (9, "n")]
    with pytest.raises(Exception, match="several rows"):
        run("MERGE INTO tt USING (SELECT * FROM VALUES (1, 'p'), (1, 'q') AS s(id, v)) s ON tt.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v")
    run("CREATE OR ALTER TABLE tt (id INT, v VARCHAR, w NUMBER(4,1)); CREATE OR ALTER TABLE tt (id INT, v VARCHAR, w NUMBER(4,1))")
    assert spark.table("default.tt").columns == ["ID", "V", "W"]
    with pytest.raises(dialect.UnsupportedStatement):
        run("CREATE OR ALTER TABLE tt (id INT)")
    run("CREATE OR REPLACE TABLE tt AS SELECT 5 AS id, 'k' AS v; GRANT SELECT ON TABLE tt TO ROLE r; CREATE SEQUENCE seq START 1")
    assert rows() == [(5, "k")] and Registry(spark).find("SEQUENCE", "seq") == "CREATE SEQUENCE seq START 1"
    assert run("SELECT '%s' AS a, %s AS b -- %s", [7]).first() == ("%s", 7)
    for refused in ("PUT file://x @s", "CREATE OR ALTER TABLE t (a WIBBLE)", "DELETE FROM a USING b WHERE 1 = 1", "UPDATE t SET a = 1 FROM b WHERE 1 = 1", "CALL no_such_thing()"):
        with pytest.raises(dialect.UnsupportedStatement):
            run(refused)
    assert [r["tableName"] for r in run("SHOW TERSE TABLES IN SCHEMA db.default LIKE 'tt'").collect()] == ["tt"] and [r["name"] for r in run("SHOW SEQUENCES IN DATABASE d").collect()] == ["SEQ"]
    run("CREATE OR REPLACE FUNCTION default.plus(a INT, b INT) RETURNS INT LANGUAGE PYTHON HANDLER = 'add' AS $$\ndef add(a, b):\n    return a + b  # ;\n$$")
    assert run("SELECT plus(id, 2) AS x FROM tt").first()[0] == 7
    run("DROP TABLE tt")


def test_load(spark, tmp_path):
    folder = tmp_path / "data"
    write(folder, **{"kinds.csv": 'code,name,amount,at\nA,"x, ""y""\nz",1.50,2024-01-02\nB,null,,\n\nC\nD,d,2,2024-01-03,EXTRA\n', "none.csv": "", "bad.csv": "n\nx\n", "kinds.yml": "columns:\n  amount: DECIMAL(12,2)\n  At: DATE\n", "bad.yaml": "columns: {n: INT}"})
    store = state.Store(spark, "load_state")
    dry = {d.name: d for d in load.load(spark, str(folder), "load_t", dry_run=True)}
    assert dry["LOAD_T.KINDS"].rows == 4 and dry["LOAD_T.NONE"].status == "FAILED" and not spark.catalog.databaseExists("load_t")
    done = {d.name: d for d in load.load(spark, str(folder), "load_t", store)}
    assert {n: (d.status, d.rows) for n, d in done.items()} == {"LOAD_T.KINDS": ("SUCCESS", 4), "LOAD_T.NONE": ("FAILED", 0), "LOAD_T.BAD": ("FAILED", 0)}
    table = spark.table("load_t.kinds")
    assert [t for _, t in table.dtypes] == ["string", "string", "decimal(12,2)", "date"]
    assert sorted(r["NAME"] or "" for r in table.collect()) == ["", "", 'd', 'x, "y"\nz']
    assert {d.status for d in load.load(spark, str(folder), "load_t", store) if "KINDS" in d.name} == {"SKIPPED"}
    load.load(spark, str(folder), "load_t", store, mode="append", force=True)
    assert spark.table("load_t.kinds").count() == 8
    payload = json.loads(report.load_json(list(dry.values()), "load_t"))
    assert payload["files"][-1] | {"checksum": "", "file_path": ""} == {"fqn": "LOAD_T.KINDS", "file_path": "", "table_name": "KINDS", "schema": "load_t", "columns": ["CODE", "NAME", "AMOUNT", "AT"], "column_types": {"AMOUNT": "DECIMAL(12,2)", "AT": "DATE"}, "row_count": 4, "checksum": ""}
    assert load.read_rows(spark, f"file://{folder}/kinds.csv", keep_blank=True).count() == 5
    spark.sql("DROP SCHEMA load_t CASCADE")


def test_strict_reader_warns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2,EXTRA\n3\n")
    rows = read_csv_strict(spark, str(tmp_path), pad=None).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["fields"]) for r in rows] == [(2, ["1", "2"]), (3, ["3", None])]


def test_missing(spark):
    spark.sql("CREATE OR REPLACE VIEW default.is_there AS SELECT 1 AS a")
    asked = spark.createDataFrame([("DEFAULT.IS_THERE", "VIEW"), ("IS_THERE", "VIEW"), ("DB.DEFAULT.IS_THERE", "VIEW"), ("DEFAULT.IS_THERE", "TABLE"), ("DEFAULT.GONE", "VIEW"), ("DEFAULT", "SCHEMA"), ("S.T", "TASK")], "fqn string, object_type string")
    assert sorted(r["fqn"] for r in catalog.missing(spark, asked).collect()) == ["DEFAULT.GONE", "DEFAULT.IS_THERE"]
    columns = {r["fqn"]: [tuple(c) for c in r["columns"]] for r in catalog.object_columns(spark, "default").collect()}
    assert columns["SPARK_CATALOG.DEFAULT.IS_THERE"] == columns["DEFAULT.IS_THERE"] == [("a", "int")]
    spark.sql("DROP VIEW default.is_there")


def test_one_bad_case(spark):
    table = spark.createDataFrame([(2, "x"), (3, "7")], "ordinal long, v string")
    cases = [quality.Case("bad", "t", "sql_expression", expression="cast(v as int) > 1"), quality.Case("good", "t", "unique", "v"), quality.Case("lost", "gone", "unique", "v")]

    def tables(name):
        if name == "gone":
            raise FileNotFoundError(name)
        return table

    got = {r["test_case"]: (r["passed"], r["message"][:18]) for r in quality.run(spark, cases, tables).collect()}
    assert got == {"bad": (False, "Error running test"), "good": (True, "ok"), "lost": (False, "Error running test")}
    many = spark.range(2, 102).select(F.col("id").alias("ordinal"), F.lit("x").alias("v"))
    told = quality.summary("m", quality.unique(many.repartition(7), "v")).first()
    assert told["n_failing"] == 99 and len(told["failing_rows"]) == 20 and told["failing_rows"][0].startswith("row 3:")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("declara.session.session", lambda: spark)
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert run("init")[0] == 0 and (tmp_path / "objects/tables/samples.sql").exists()
    (tmp_path / "declara.yml").write_text((tmp_path / "declara.yml").read_text() + "data-schema: cli_data\n")
    plan = json.loads(run("plan", "--json")[1])
    assert plan["total"] == 3 and plan["objects"][-1]["dependencies"] == ["PUBLIC.SAMPLES"] and set(plan["objects"][0]) == set(report.OBJECT)
    assert "PUBLIC.NAMED_SAMPLES <- PUBLIC.SAMPLES" in run("plan")[1]
    assert run("load", "--dry-run") == (0, "FOUND    CLI_DATA.KINDS  2 columns, 2 rows\n1 files, 0 loaded, 0 failed\n") and not spark.catalog.databaseExists("cli_data")
    assert json.loads(run("load", "--json")[1])["files"][0]["row_count"] == 2 and not spark.catalog.databaseExists("cli_data")
    assert run("load")[0] == 0 and spark.table("cli_data.kinds").count() == 2
    assert run("test")[0] == 0
    (tmp_path / "data/kinds.csv").write_text("code,name\nA,x\nA,y\n")
    code, out = run("test", "kinds")
    assert code == 1 and "duplicate 'A'" in out
    (tmp_path / "data/kinds.txt").write_text("")
    assert run("test")[0] == 1
    whole = json.loads(run("graph", "--json")[1])
    assert {n["name"]: n["schema"] for n in whole["nodes"]} == {"PUBLIC": "", "SAMPLES": "PUBLIC", "NAMED_SAMPLES": "PUBLIC"} and whole["node_columns"]["PUBLIC.SAMPLES"][0] == {"name": "ID", "type": "NUMBER(10,0)"}
    assert whole["edges"] == [{"source": "PUBLIC.NAMED_SAMPLES", "target": "PUBLIC.SAMPLES", "type": "dependency", "object_type": "VIEW"}] and whole["violations"] == []
    assert run("lineage", "--json")[0] == 2 and run("lineage", "--json", "--local", "--object", "no.no")[0] == 2
    part = json.loads(run("lineage", "--json", "--local", "--object", "public.samples", "--direction", "down")[1])
    assert (part["focus"], part["depth"], part["direction"], part["truncated"], len(part["nodes"])) == ("PUBLIC.SAMPLES", 1, "down", False, 2)
    assert len(json.loads(run("lineage", "--json", "--local")[1])["nodes"]) == 3
    assert run("deploy")[0] == 0 and "SUCCESS  PUBLIC.SAMPLES" in run("history")[1]
    for more in ([], ["--local"], ["--object", "public.samples"]):
        assert run("lineage", "--output", "x.html", *more)[0] == 0
        assert "PUBLIC.NAMED_SAMPLES" in (tmp_path / "x.html").read_text()
    told = json.loads(run("resources", "--json")[1])
    assert {"schema", "type", "name", "fqn", "created_on", "owner", "comment"} == set(told["resources"][0]) and told["database"]
    (tmp_path / "objects/bad.sql").write_text("CREATE TABLE public.bad (a INT)")
    assert run("plan")[0] == 1 and "wanted CREATE OR ALTER" in json.loads(run("graph", "--json")[1])["violations"][0]
    monkeypatch.setenv("DECLARA_OBJECTS_FOLDER", "none")
    assert json.loads(run("plan", "--json")[1])["total"] == 0
    for name in ("public", "cli_data"):
        spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")
    logging.getLogger().handlers.clear()


def test_apps(tmp_path, capsys):
    write(tmp_path, **{"a__snowflake.yml": "definition_version: 2\nentities:\n  two: {type: Streamlit, title: Two, imports: [x.py]}\n  other: {type: function}\n", "b__snowflake.yaml": "streamlit: {main_file: m.py}", "c__snowflake.yml": "a: [", "venv__snowflake.yml": "streamlit: {name: no}", "d__e__f__g__h__i__snowflake.yml": "streamlit: {name: deep}"})
    for name in ("a", "b", "c", "venv", "d/e/f/g/h/i"):
        made = next((tmp_path / name).iterdir(), None)
        assert made is not None
    assert cli.main(["apps", str(tmp_path), "--json"]) == 0
    found = json.loads(capsys.readouterr().out)["apps"]
    assert [(a["name"], a["title"], a["main_file"], a["stage"], a["imports"]) for a in found] == [("b", "b", "m.py", "@b_stage", []), ("two", "Two", "streamlit_app.py", "@two_stage", ["x.py"])]


def test_follow(spark, tmp_path):
    store = state.Store(spark, "stream_state")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    schema = "object_fqn string, object_type string, file_path string, status string, deployed_at timestamp"
    rows = [("A.T", "TABLE", "a.sql", "SUCCESS"), ("A.V", "VIEW", "v.sql", "FAILED")]
    spark.createDataFrame(rows, "object_fqn string, object_type string, file_path string, status string").withColumn("deployed_at", at).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "at")).awaitTermination()
    assert [(r["object_fqn"], r["status"]) for r in store.read("object_lifecycle").collect()] == [("A.T", "ACTIVE")]


def test_rounds_are_removed(spark):
    from declara.operators import tables

    edges = spark.createDataFrame([(f"v{i + 1}", f"v{i}") for i in range(6)], "source string, target string")
    rounds, before = [], len(tables._written)
    assert graph.closure(edges, spark.createDataFrame([("v0",)], "x string"), small=0).count() == 6
    for _, path in tables._written[before:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        rounds.append(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))
    assert rounds.count(True) == 2 and rounds.count(False) == 7  # the steps and the result stay until the end
