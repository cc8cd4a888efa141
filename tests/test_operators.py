import random

import pytest
from pyspark.sql import functions as F

from declara.functions.tokens import columns, list_items, statements
from declara.functions.types import UnknownType, spark_type
from declara.operators import extract, graph, quality, state
from declara.operators.lineage import lineage
from declara.plans.dialect import UnsupportedStatement, bound, rewrite
from declara.sources.project import csv_table, read_corpus


@pytest.mark.parametrize(
    "sql, count",
    [("SELECT 1; SELECT 2", 2), ("SELECT ';'", 1), ("-- a;b\nSELECT 1;", 1), ("/* ; */ SELECT 1;;", 1), ("$$ a; b $$; SELECT 1", 2), ("SELECT 'it''s; x'; y", 2), ("", 0)],
)
def test_statements(sql, count):
    assert len(statements(sql)) == count


def test_columns():
    sql = 'CREATE TABLE a (id NUMBER(10,2) NOT NULL, "Odd" VARCHAR(3) DEFAULT 1, v, PRIMARY KEY (id, v))'
    assert columns(sql, "TABLE", len("CREATE TABLE a")) == [("ID", "NUMBER(10,2)"), ("ODD", "VARCHAR(3)"), ("V", "VARIANT")]
    assert list_items("a, f(b, c), d") == ["a", "f(b, c)", "d"]


def test_types():
    assert spark_type("NUMBER").simpleString() == "decimal(38,0)"
    assert spark_type("number(12, 2)").simpleString() == "decimal(12,2)"
    with pytest.raises(UnknownType):
        spark_type("WIBBLE")


FILES = {
    "a/tables.sql": "USE SCHEMA sales;\nCREATE OR ALTER TABLE {{t}} (id NUMBER, at DATE);",
    "b/view.sql": "-- @depends_on: other.thing\nUSE SCHEMA sales;\nCREATE VIEW v AS SELECT * FROM base JOIN sales.lines USING (id) WHERE x = 'FROM hidden' -- FROM remark\n",
    "c/proc.sql": "CREATE OR REPLACE PROCEDURE sales.p() LANGUAGE SQL AS $$ BEGIN INSERT INTO sales.out SELECT * FROM sales.base; END $$;",
    "c/dynamic.sql": "CREATE OR REPLACE PROCEDURE sales.q() LANGUAGE SQL AS $$ BEGIN EXECUTE IMMEDIATE 'SELECT * FROM sales.base'; END $$;",
    "d/stream.sql": "CREATE STREAM sales.s ON TABLE sales.base;\nDROP TABLE IF EXISTS sales.old;",
    "e/grants.sql": "GRANT SELECT ON TABLE sales.base TO ROLE r;",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("objects")
    for name, text in FILES.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    return extract.objects(read_corpus(spark, str(folder)), {"t": "base"}).cache()


def test_objects(found):
    rows = {r["fqn"]: r for r in found.collect()}
    assert set(rows) == {"SALES.BASE", "SALES.V", "SALES.P", "SALES.Q", "SALES.S", "SALES.OLD", "GRANTS"}
    assert [tuple(c) for c in rows["SALES.BASE"]["columns"]] == [("ID", "NUMBER"), ("AT", "DATE")]
    assert set(rows["SALES.V"]["dependencies"]) == {"SALES.BASE", "SALES.LINES", "OTHER.THING"}
    assert rows["SALES.OLD"]["is_drop"] and rows["GRANTS"]["object_type"] == "SCRIPT" and rows["GRANTS"]["dependencies"] == ["SALES.BASE"]
    bad = extract.violations(found).collect()
    assert [(r["fqn"], r["line_number"], r["found_form"]) for r in bad] == [("SALES.V", 3, "CREATE")]


def test_lineage(found):
    rows = {r["object_fqn"]: (r["sources"], r["targets"]) for r in lineage(found).collect()}
    assert rows == {"SALES.P": (["SALES.BASE"], ["SALES.OUT"]), "SALES.S": (["SALES.BASE"], [])}


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_graph(spark):
    rng = random.Random(3)
    pairs = sorted({(f"v{b:02}", f"v{a:02}") for a, b in (sorted(rng.sample(range(15), 2)) for _ in range(25))})
    e = edges_of(spark, pairs)
    v = e.select(F.col("source").alias("fqn")).union(e.select("target")).distinct()
    level = {r["fqn"]: r["level"] for r in graph.topo_levels(v, e).collect()}
    assert all(level[s] > level[d] for s, d in pairs) and level == {r["fqn"]: r["level"] for r in graph.topo_levels(v, e, small=0).collect()}
    want, grow = set(), {"v01"}
    while grow:
        grow = {s for s, d in pairs if d in grow} - want
        want |= grow
    for small in (graph.SMALL, 0):  # in memory and by rounds
        assert {r[0] for r in graph.closure(e, spark.createDataFrame([("v01",)], "x string"), small=small).collect()} == want


def test_cycle(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "z")])
    v = e.select(F.col("source").alias("fqn")).union(e.select("target")).distinct()
    for small in (graph.SMALL, 0):
        assert {r[0] for r in graph.cycle_residue(v, e, small).collect()} == {"a", "b", "c", "x"}
        assert {r[0] for r in graph.on_cycles(v, e, small).collect()} == {"a", "b", "c"}
    path = graph.cycle_witness(v, e)
    assert path[0] == path[-1] and set(path) == {"a", "b", "c"}


def test_subgraph(spark):
    e = edges_of(spark, [("A", "B"), ("B", "C")])
    v = spark.createDataFrame([(x, "TABLE") for x in "ABC"], "fqn string, object_type string")
    none = spark.createDataFrame([("B", "T", "writes")], "source string, target string, type string")
    for small in (graph.SMALL, 0):
        nodes, edges, truncated = graph.subgraph(v, e, none, "b", 1, "up", small)
        assert [tuple(r) for r in nodes.collect()] == [("B", "TABLE"), ("C", "TABLE"), ("T", "EXTERNAL")] and not truncated
    assert graph.subgraph(v, e, none, "a", 1, "up")[2] and graph.subgraph(v, e, none, "zz", 1, "up") is None
    with pytest.raises(ValueError):
        graph.subgraph(v, e, none, "a", 0, "up")


def test_quality(spark, tmp_path):
    (tmp_path / "users.csv").write_text('id,name,status\n1,a,ACTIVE\n\n1,"",NULL\n3,"x\ny",GONE\n')
    users = csv_table(spark, str(tmp_path / "users.csv"))
    rows = lambda df: [r["ordinal"] for r in df.orderBy("ordinal").collect()]
    assert rows(users) == [2, 3, 4]
    assert rows(quality.unique(users, "id")) == [3]
    assert rows(quality.not_null(users, "name")) == [3] and rows(quality.not_null(users, "status")) == [3]
    assert rows(quality.accepted_values(users, "status", ["ACTIVE"])) == [3, 4]
    assert rows(quality.relationship(users, "id", users.where("id = '1'"), "id")) == [4]
    assert rows(quality.expression(users, "int(id) > 2")) == [2, 3]
    with pytest.raises((SyntaxError, quality.Rejected)):
        quality.compiled("import os")
    with pytest.raises(quality.Rejected):
        quality.compiled("id.__class__")
    cases = [quality.Case("a", "users", "row_count", min=1), quality.Case("b", "users", "wibble"), quality.Case("c", "users", "unique", "nope")]
    assert [(r["test_case"], r["passed"]) for r in quality.run(spark, cases, lambda n: users).orderBy("test_case").collect()] == [("a", True), ("b", False), ("c", False)]


def test_store(spark):
    store = state.Store(spark, "state_test")
    store.record([("A", "TABLE", "a.sql", "1", "SUCCESS", None, "x"), ("A", "TABLE", "a.sql", "2", "FAILED", "e" * 6000, "x")])
    store.record([("A", "TABLE", "a.sql", "3", "SUCCESS", None, "x")])
    assert [r["checksum"] for r in state.latest_success(store.read("deploy_history")).collect()] == ["3"]
    assert store.read("deploy_history").agg(F.max(F.length("error_message"))).first()[0] == 5000
    table = state.upsert(store.read("object_lifecycle"), spark.createDataFrame([("A", "TABLE", "a.sql")], "object_fqn string, object_type string, file_path string"), F.current_timestamp())
    store.replace("object_lifecycle", table)
    gone = spark.createDataFrame([("A",)], "object_fqn string")
    store.replace("object_lifecycle", state.retire(store.read("object_lifecycle"), gone, "REMOVED", F.current_timestamp()))
    assert store.read("object_lifecycle").first()["status"] == "RETIRED"
    spark.sql("DROP TABLE state_test.deploy_history")  # as when a catalog goes with its session
    assert state.Store(spark, "state_test").read("deploy_history").count() == 3


def test_dialect():
    for kept in ("SELECT 'x/*y*/z'", "INSERT INTO t VALUES ('a--b', 1)", "SELECT 'a%sb' -- it's"):
        assert rewrite(kept).sql == kept
    assert rewrite("CREATE OR ALTER VIEW v AS SELECT 'a--b' AS x").sql == "CREATE OR REPLACE VIEW v AS SELECT 'a--b' AS x"
    assert bound("SELECT '%s', a FROM t WHERE b = %s -- %s") == "SELECT '%s', a FROM t WHERE b = ? -- %s"
    replaced = rewrite("CREATE OR REPLACE TABLE t (a INT DEFAULT 3 NOT NULL, b DATE, PRIMARY KEY (a))")
    assert replaced.before == ["DROP TABLE IF EXISTS t"] and "`A` bigint DEFAULT 3" in replaced.sql and "PRIMARY KEY (a)" in replaced.sql
    assert rewrite("CREATE TABLE t (a INT)").sql.startswith("CREATE TABLE t (")
    assert rewrite('SELECT "Odd" FROM db.s."t u"').sql == "SELECT `Odd` FROM s.`t u`"
    assert rewrite("CREATE OR ALTER SCHEMA db.s").sql == "CREATE SCHEMA IF NOT EXISTS s"
    assert rewrite("GRANT SELECT ON TABLE t TO ROLE r").sql is None
    assert "ADD COLUMNS" in rewrite("CREATE OR ALTER TABLE t (a INT, b INT)", ["a"]).sql
    for refused in ("MERGE INTO t USING s ON 1=1", "DELETE FROM t USING s", "CREATE FUNCTION f() RETURNS INT LANGUAGE JAVASCRIPT AS 'x'", "CREATE OR ALTER TABLE t (a WIBBLE)"):
        with pytest.raises(UnsupportedStatement):
            rewrite(refused)
