"""What keeps queries on a corpus of many files within their time."""

import sys

import pytest
from pyspark.sql import functions as F

from declara.functions.analysis import head_in, head_of, told
from declara.functions.tokens import statements_of, tokens
from declara.operators import extract
from declara.queries import QUERIES
from declara.queries_text import BODIES, OBJECTS, READ, filled, lineage_rows, texts


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A table of one small file, of 100 parts."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = spark.range(100).select(F.col("id").alias("p_partkey"), F.concat(F.lit("it's "), "id").alias("p_name"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def tasks_with_rows(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


@pytest.mark.parametrize("name, rows", [("columns_extract", 300), ("policy_violations", 100)])
def test_small_files_are_parsed_in_many_tasks(spark, parts, name, rows):
    found = QUERIES[name](spark, parts)
    assert found.count() == rows
    assert tasks_with_rows(found) >= 8


def calls(f) -> int:
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


@pytest.mark.parametrize("text, most", [(OBJECTS, 2000), (BODIES, 4000)])
def test_steps_of_the_parse(text, most):
    told(text, "f.sql")
    assert calls(lambda: told(text, "f.sql")) < most


def test_lineage_is_made_from_few_columns(spark, parts):
    objects, told_rows = lineage_rows(spark, parts)
    assert not {"raw_sql", "resolved_sql", "script"} & set(objects.columns)
    assert told_rows.count() == 500  # of seven objects a file, five read or write
    rows = {(r["object_fqn"], r["sources"], r["targets"]) for r in QUERIES["lineage_override"](spark, parts).collect()}
    assert rows == {(f"S.SQL_{i}", "A.B", f"S.GONE,S.OUT_{i}") for i in range(100)}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_last_definitions_carry_what_is_read(spark, parts):
    found = extract.current(extract.objects(texts(spark, parts, filled(OBJECTS))))
    assert "script" not in plan(found.select("fqn", "file_path"))


def test_external_dependencies_parse_once(spark, parts):
    assert "objects_of" not in plan(QUERIES["external_dependencies"](spark, parts))


def test_lineage_is_looked_for_where_names_match(spark, parts):
    named = r"s\.sql.*"
    assert told(BODIES, "f.sql", READ, named) == [{k: r[k] for k in READ} for r in told(BODIES, "f.sql") if r["raw_name"].startswith("s.sql")]
    assert calls(lambda: told(BODIES, "f.sql", READ, named)) < 1000
    assert lineage_rows(spark, parts, named)[0].count() == 100  # one object a file is written aside, not seven


ODD_HEADS = """CREATE TABLE IF EXISTS x (a INT); CREATE OR ALTER /* ; */ TRANSIENT TABLE IF NOT EXISTS "a;""b" -- ; c
. c.d.e (a INT); DROP MATERIALIZED -- x
VIEW IF EXISTS é.v; DROP VIEW IF NOT EXISTS v; CREATE FILE x; CREATE taſk t AS BEGIN SELECT CASE WHEN a THEN b END; END; CREATE$x TABLE y; create or replace
secure view "q"; CREATE TABLE; CREATE TABLE t$1.$$x$$; DROP TABLE a.1; BEGIN; $A$ ; $a$ ; $A$ SELECT 1; CREATE OR DROP TABLE t; BEGIN SELECT 1; END"""


def test_statements_and_heads_from_the_text():
    found = statements_of(ODD_HEADS)
    assert len(found) == 15
    for s in found:
        head, read = head_of(tokens(s.text, every=False)), head_in(s)
        assert (read and read._replace(end=0)) == (head and head._replace(end=0))
        assert s.code == [t._replace(start=t.start + s.start) for t in tokens(s.text, every=False)]


def test_violations_are_found_from_heads():
    judged = told(OBJECTS, "f.sql", extract.JUDGED)
    assert judged == [{k: r[k] for k in extract.JUDGED} for r in told(OBJECTS, "f.sql")]
    assert calls(lambda: told(OBJECTS, "f.sql", extract.JUDGED)) < 500
