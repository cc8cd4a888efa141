"""Queries of operators on SQL text, of the dialect, of changes to tables and of reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import sqltext as S
from .functions.analysis import STOP_WORDS, references_of, without_comments
from .functions.tokens import split_statements
from .operators import extract, graph, lineage, quality, state
from .operators.tables import settled, shared_folder, spread
from .plans import catalog, deploy, dialect, report
from .queries_tables import FK, ends, fk_edges, numbered, query, t


@query("SELECT o_orderkey + 2 AS ordinal FROM orders WHERE o_orderstatus NOT IN ('F', 'O') ORDER BY 1 LIMIT 20")
def dq_sample_cap(spark, sf_dir):
    found = quality.accepted_values(numbered(t(spark, sf_dir, "orders"), "o_orderkey"), "o_orderstatus", ["F", "O"])
    return quality.summary("status", found).select(F.explode("failing_rows").alias("m")).select(F.regexp_extract("m", r"^row (\d+):", 1).cast("long").alias("ordinal"))


@query("SELECT page_id, 'https://' || split_part(url, '/', 3) || '/x' AS address FROM pages")
def address_extract(spark, sf_dir):
    message = F.concat(F.lit("failed, see https://"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/x or https://no.other"))
    return t(spark, sf_dir, "pages").select("page_id", S.web_address(message).alias("address"))


def texts(spark, sf_dir, text: Column, name: str = "part", key: str = "p_partkey") -> DataFrame:
    """A corpus with a file for each row of a table."""
    path = F.concat(F.lit("file:///objects/f_"), F.col(key), F.lit(".sql"))
    return spread(t(spark, sf_dir, name), key).select(path.alias("file_path"), text.alias("raw_sql"), F.md5(text.cast("binary")).alias("checksum"))


def filled(template: str, key: str = "p_partkey", name: str = "p_name") -> Column:
    """A text with the row's key for %k and its name, quotes doubled, for %n."""
    return F.replace(F.replace(F.lit(template), F.lit("%k"), F.col(key).cast("string")), F.lit("%n"), F.replace(F.col(name), F.lit("'"), F.lit("''")))


OBJECTS = """USE SCHEMA d2.s2; -- @depends_on: x.y, x.z
CREATE OR ALTER TABLE t_%k (id NUMBER(10,0) NOT NULL, "Odd;" VARCHAR(5) DEFAULT 'a;b--%n', CONSTRAINT c FOREIGN KEY (id) REFERENCES s2.parent(id));
/* CREATE TABLE hidden (a INT); */ CREATE OR REPLACE VIEW v_%k (a, b) AS SELECT * FROM t_%k, other.o o JOIN "r;" r ON 'FROM no -- %n' = r.x -- FROM nobody
WHERE x IN (SELECT y FROM $$ FROM dollars $$);
CREATE OR ALTER VIEW w_%k AS SELECT * FROM v_%k;
GRANT SELECT ON TABLE s2.granted TO ROLE r; DROP TABLE IF EXISTS old.t_%k;"""


@query("""SELECT p_partkey::VARCHAR AS k, stem || p_partkey AS fqn, object_type, is_drop, replace(d, '#', p_partkey::VARCHAR) AS deps FROM part, (VALUES ('S2.T_', 'TABLE', false, 'S2.PARENT,X.Y,X.Z'),
  ('S2.V_', 'VIEW', false, 'OTHER.O,S2.R;,S2.T_#'), ('S2.W_', 'VIEW', false, 'S2.GRANTED,S2.V_#'), ('OLD.T_', 'TABLE', true, '')) o(stem, object_type, is_drop, d)""")
def object_extract(spark, sf_dir):
    found = extract.objects(texts(spark, sf_dir, filled(OBJECTS)))
    return found.select(F.regexp_extract("file_path", r"f_(\d+)", 1).alias("k"), "fqn", "object_type", "is_drop", F.array_join("dependencies", ",").alias("deps"))


@query("SELECT stem || p_partkey AS fqn, cols FROM part, (VALUES ('S2.T_', 'ID NUMBER(10,0),ODD; VARCHAR(5)'), ('S2.V_', 'A ,B '), ('S2.W_', '')) o(stem, cols)")
def columns_extract(spark, sf_dir):
    found = extract.objects(texts(spark, sf_dir, filled(OBJECTS))).where("NOT is_drop")
    return found.select("fqn", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",").alias("cols"))


@query("SELECT 'S2.V_' || p_partkey AS fqn, 'CREATE OR REPLACE' AS found_form, 'CREATE OR ALTER' AS suggested_form, 3::INT AS line_number, 36::INT AS caret_at, 'CREATE OR ALTER VIEW v_' || p_partkey AS fixed FROM part")
def policy_violations(spark, sf_dir):
    found = report.violation_lines(extract.violations(extract.objects(texts(spark, sf_dir, filled(OBJECTS)), only=extract.JUDGED)))
    return found.select("fqn", "found_form", "suggested_form", "line_number", F.instr("carets", "^").alias("caret_at"), F.regexp_extract("fixed_line", r"(CREATE OR ALTER VIEW \w+)", 1).alias("fixed"))


@query("SELECT 'S2.T_' || p_partkey AS fqn, 'f_' || p_partkey || '.sql' AS file FROM part")
def last_definition(spark, sf_dir):
    files = texts(spark, sf_dir, filled(OBJECTS))
    older = files.withColumn("file_path", F.replace("file_path", F.lit("/f_"), F.lit("/e_")))
    return extract.current(extract.objects(files.unionByName(older))).where("fqn LIKE 'S2.T%'").select("fqn", F.substring_index("file_path", "/", -1).alias("file"))


@query("SELECT x AS target FROM (VALUES ('S2.GRANTED'), ('S2.PARENT'), ('S2.R;'), ('OTHER.O'), ('X.Y'), ('X.Z')) w(x)")
def external_dependencies(spark, sf_dir):
    defined = extract.current(extract.objects(texts(spark, sf_dir, filled(OBJECTS)))).select("fqn", "file_path", "dependencies")
    return graph.external(settled(defined)).select("target").distinct()


BODIES = """CREATE OR REPLACE PROCEDURE s.sql_%k() RETURNS VARCHAR LANGUAGE SQL AS $$ BEGIN -- FROM s.remark
 INSERT INTO s.out_%k SELECT '%n FROM s.text' FROM s.in_%k a JOIN s.j USING (id); DELETE FROM s.gone; END $$;
CREATE OR REPLACE PROCEDURE s.dyn_%k() LANGUAGE SQL AS $$ BEGIN EXECUTE IMMEDIATE 'SELECT * FROM s.in_%k'; END $$;
CREATE OR REPLACE PROCEDURE s.js_%k() LANGUAGE JAVASCRIPT AS $$ // sqlText: "SELECT * FROM s.remark"
 run({sqlText: "MERGE INTO s.m_%k USING s.in_%k ON a = b"}); $$;
CREATE OR REPLACE PROCEDURE s.py_%k() LANGUAGE PYTHON HANDLER = 'run' AS $$
from a.b import c  # session.table("s.remark")
def run(session):
    session.sql("INSERT INTO s.p_%k SELECT * FROM s.q").collect(); session.table('s.in_%k').write.save_as_table("s.saved") $$;
CREATE OR REPLACE FUNCTION s.java_%k() RETURNS INT LANGUAGE JAVA AS $$ // FROM s.no
 $$;
CREATE OR ALTER TASK s.task_%k WAREHOUSE = w SCHEDULE = '5 MINUTE FROM now' AFTER s.root, s.sql_%k WHEN SYSTEM$STREAM_HAS_DATA('s.str_%k') AS BEGIN UPDATE s.u_%k SET a = 1; TRUNCATE TABLE IF EXISTS s.cut; END;
CREATE OR ALTER STREAM s.str_%k ON TABLE s.in_%k;"""
EDGES = """('SQL', 'reads', 'S.IN_#'), ('SQL', 'reads', 'S.J'), ('SQL', 'reads', 'S.GONE'), ('SQL', 'writes', 'S.OUT_#'), ('SQL', 'writes', 'S.GONE'), ('JS', 'reads', 'S.IN_#'), ('JS', 'writes', 'S.M_#'),
  ('PY', 'reads', 'S.Q'), ('PY', 'reads', 'S.IN_#'), ('PY', 'writes', 'S.P_#'), ('PY', 'writes', 'S.SAVED'), ('TASK', 'reads', 'S.ROOT'), ('TASK', 'reads', 'S.SQL_#'), ('TASK', 'reads', 'S.STR_#'),
  ('TASK', 'writes', 'S.U_#'), ('TASK', 'writes', 'S.CUT'), ('STR', 'reads', 'S.IN_#')"""


READ = ("object_type", "raw_name", "fqn", "is_drop", "line_number", "sources", "targets")


def lineage_rows(spark, sf_dir, named: str = ".*") -> tuple[DataFrame, DataFrame]:
    objects = settled(extract.objects(texts(spark, sf_dir, filled(BODIES)), only=READ, named=named).select("file_path", *READ))
    return objects, lineage.lineage(objects)


@query(f"SELECT 'S.' || s || '_' || p_partkey AS source, replace(o, '#', p_partkey::VARCHAR) AS target, t AS type FROM part, (VALUES {EDGES}) e(s, t, o)")
def lineage_edges(spark, sf_dir):
    objects, told = lineage_rows(spark, sf_dir)
    return graph.all_edges(objects.withColumn("dependencies", F.array().cast("array<string>")), told).select("source", "target", "type")


@query("SELECT 'S.SQL_' || p_partkey AS object_fqn, 'A.B' AS sources, 'S.GONE,S.OUT_' || p_partkey AS targets, 'said' AS description FROM part")
def lineage_override(spark, sf_dir):
    objects, _ = lineage_rows(spark, sf_dir, r"s\.sql.*")
    told = objects.select("file_path", F.array(F.lit("A.B")).alias("sources"), F.array().cast("array<string>").alias("targets"), F.lit("said").alias("description"))
    return lineage.lineage(objects, told).select("object_fqn", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets"), "description")


@query(f"SELECT p_partkey, CASE WHEN upper(split_part(p_name, ' ', 1)) IN ({', '.join(repr(w) for w in STOP_WORDS)}) THEN '' ELSE upper(split_part(p_name, ' ', 1)) || ',' END || 'S.T_' || p_partkey AS refs FROM part")
def reference_extract(spark, sf_dir):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    text = F.concat(F.lit("SELECT 'FROM a' AS x /* FROM b */ FROM "), word, F.lit(" JOIN s.t_"), F.col("p_partkey").cast("string"), F.lit(" ON 1 = 1 WHERE y IN (SELECT z FROM dual)"))
    found = references_of(text)
    last = F.filter(found, lambda x: x.startswith("S.T_"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.concat(F.array_except(found, last), last), ",").alias("refs"))


@query("SELECT page_id, md5(replace(replace(html || '{{a}} {{b}} {{ a }} {{c}}', '{{a}}', 'x{{b}}'), '{{b}}', 'it''s')) AS h FROM pages")
def template_substitute(spark, sf_dir):
    text = S.substituted(F.concat("html", F.lit("{{a}} {{b}} {{ a }} {{c}}")), {"a": "x{{b}}", "b": "it's"})
    return t(spark, sf_dir, "pages").select("page_id", F.md5(text.cast("binary")).alias("h"))


@query("SELECT doc_id, md5('SELECT ''--' || replace(text, '''', '''''') || '/*''    ' || chr(10) || ' FROM a  b') AS h FROM documents")
def strip_comments(spark, sf_dir):
    text = F.concat(F.lit("SELECT '--"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("/*' /* it's */ -- x' /*\n FROM a /* '"), F.replace("text", F.lit("*/"), F.lit("")), F.lit("*/b"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(without_comments(text).cast("binary")).alias("h"))


@query("SELECT doc_id, 4::BIGINT AS n, md5('SELECT ''' || replace(text, '''', '''''') || ';''') AS first, md5('BEGIN SELECT 1; SELECT CASE WHEN a THEN b END; END') AS last FROM documents")
def statement_split(spark, sf_dir):
    quoted = F.concat(F.lit("SELECT '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit(";'"))
    dollars = F.concat(F.lit("SELECT $x$"), F.replace("text", F.lit("$x$"), F.lit("")), F.lit(";$x$"))
    remark = F.concat(F.lit("-- "), F.translate("text", "\n", " "), F.lit(';\n/* ; \' */ SELECT "a;b"'))
    parts = split_statements(F.concat_ws(";\n", quoted, dollars, remark, F.lit(" ; \n"), F.lit("BEGIN SELECT 1; SELECT CASE WHEN a THEN b END; END;")))
    return t(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.element_at(parts, 1).cast("binary")).alias("first"), F.md5(F.element_at(parts, -1).cast("binary")).alias("last"))


def by_dialect(spark, sf_dir, sql: str, *names: str) -> DataFrame:
    """A query as a project would write it, through the rewriter."""
    for name in names:
        t(spark, sf_dir, name).createOrReplaceTempView(name)
    return dialect.execute(spark, sql)


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_path(spark, sf_dir):
    return by_dialect(spark, sf_dir, "SELECT event_id, parse_json(props):k::STRING AS k FROM events;", "events")


@query("SELECT event_id, unnest(json_keys(props)) AS k FROM events")
def dialect_flatten(spark, sf_dir):
    return by_dialect(spark, sf_dir, "SELECT e.event_id, f.key AS k FROM events e, LATERAL FLATTEN(INPUT => parse_json(e.props)) f", "events")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dialect_qualify(spark, sf_dir):
    sql = "SELECT * FROM (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' -- QUALIFY no\n QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) = 1) q ORDER BY 1"
    return by_dialect(spark, sf_dir, sql, "events")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS at, date_trunc('second', ts) - INTERVAL 30 DAY AS before FROM events")
def dialect_times(spark, sf_dir):
    shown = t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("s"))
    shown.createOrReplaceTempView("shown")
    model = "TO_TIMESTAMP_NTZ(s, 'DY, DD MON YYYY HH24:MI:SS GMT')"
    return dialect.execute(spark, f"SELECT event_id, {model} AS at, DATEADD(day, -30, {model}) AS before FROM shown")


@query("SELECT n_nationkey, 'it''s -- a /*b*/ %s ; ' || n_name AS v FROM nation WHERE n_nationkey >= 3")
def dialect_literals(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return dialect.execute(spark, "SELECT n_nationkey, 'it''s -- a /*b*/ %s ; ' || n_name AS v FROM nation WHERE n_nationkey >= %s /* ; */", [3])


def changed_table(spark, sf_dir, *statements: str, name: str = "customer") -> DataFrame:
    """A copy of a table in the catalog after statements on it (named ``{t}``)."""
    schema = "declara_queries"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    table = f"{schema}.t_{uuid.uuid4().hex}"
    t(spark, sf_dir, name).write.saveAsTable(table)
    for sql in statements:
        dialect.execute(spark, sql.replace("{t}", table))
    out = settled(spark.table(table))
    spark.sql(f"DROP TABLE {table}")
    return out


@query("""SELECT c_custkey, CASE WHEN hit THEN 'it''s; --' || c_name ELSE c_name END AS c_name, CASE WHEN hit THEN 0 ELSE c_nationkey END::INT AS c_nationkey
FROM (SELECT *, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS hit FROM customer)""")
def dml_update(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return changed_table(spark, sf_dir, "UPDATE {t} c SET c_name = 'it''s; --' || c_name, c_nationkey = 0 WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING')")
def dml_delete(spark, sf_dir):
    return changed_table(spark, sf_dir, "DELETE FROM {t} WHERE c_custkey % 3 = 0; DELETE FROM {t} WHERE c_mktsegment = 'BUILDING'").select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_nationkey = 0)
UNION ALL SELECT -c_custkey, 'added', 7 FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 5 AND c_custkey <> 0""")
def dml_merge(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    old, new = c.select("c_custkey", F.lit("new").alias("name"), "c_nationkey"), c.where("c_custkey <> 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("added").alias("name"), "c_nationkey")
    old.union(new).createOrReplaceTempView("changes")
    sql = """MERGE INTO {t} AS c USING (SELECT * FROM changes) s ON c.c_custkey = s.c_custkey WHEN MATCHED AND c.c_nationkey = 0 THEN DELETE
    WHEN MATCHED THEN UPDATE SET c.c_name = s.name WHEN NOT MATCHED AND s.c_nationkey <> 5 THEN INSERT (c_custkey, c_name, c_nationkey) VALUES (s.c_custkey, s.name, 7)"""
    return changed_table(spark, sf_dir, sql).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'it''s, ' || n_name, n_regionkey FROM nation")
def dml_copy(spark, sf_dir):
    folder = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    t(spark, sf_dir, "nation").select(F.col("n_nationkey") + 100, F.concat(F.lit("it's, "), "n_name"), "n_regionkey").write.option("header", True).csv(folder)
    stage = f"s_{uuid.uuid4().hex}"
    return changed_table(spark, sf_dir, f"CREATE STAGE {stage} URL = '{folder}'", f"COPY INTO {{t}} FROM @{stage}/ FILE_FORMAT = (TYPE = CSV, SKIP_HEADER = 1)", name="nation")


@query("SELECT count(*) AS result FROM orders WHERE o_orderstatus = 'F'")
def dialect_procedure(spark, sf_dir):
    t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    name = f"p_{uuid.uuid4().hex}"
    body = "DECLARE n INTEGER; BEGIN SELECT count(*) INTO :n FROM orders WHERE o_orderstatus = :status; RETURN :n; END"
    return dialect.execute(spark, f"CREATE OR REPLACE PROCEDURE {name}(status VARCHAR) RETURNS INTEGER LANGUAGE SQL AS $$ {body} $$; CALL {name}('F');")


@query("SELECT c_custkey, c_name || ', \"x\"' || chr(10) || 'it''s' AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END::BIGINT AS c_nationkey FROM customer")
def csv_roundtrip(spark, sf_dir):
    from .plans.load import load

    folder, schema = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}", f"declara_{uuid.uuid4().hex}"
    told = F.when(F.col("c_custkey") % 10 == 0, "").when(F.col("c_custkey") % 5 == 0, "null").otherwise(F.col("c_nationkey").cast("string"))
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"\nit\'s')).alias("c_name"), told.alias("c_nationkey"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/out")
    _rename(spark, f"{folder}/out", ".csv", f"{folder}/customers.csv")
    spark.createDataFrame([("columns:\n  c_custkey: BIGINT\n  C_NATIONKEY: INT\n",)], "value string").coalesce(1).write.text(f"{folder}/told")
    _rename(spark, f"{folder}/told", ".txt", f"{folder}/customers.yml")
    done = load(spark, folder, schema)
    if [d.status for d in done] != ["SUCCESS"]:
        raise RuntimeError(str(done))
    out = settled(spark.table(f"{schema}.customers"))
    _drop(spark, schema)
    return out.select(F.col("C_CUSTKEY").alias("c_custkey"), F.col("C_NAME").alias("c_name"), F.col("C_NATIONKEY").alias("c_nationkey"))


def _drop(spark, schema: str) -> None:
    """The schema with the files of its tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(spark.catalog.getDatabase(schema).locationUri)
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _rename(spark, folder: str, suffix: str, to: str) -> None:
    """Moves the one file with the suffix."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    name = next(x.getPath() for x in system.listStatus(at) if x.getPath().getName().endswith(suffix))
    system.rename(name, spark._jvm.org.apache.hadoop.fs.Path(to))


@query("""WITH c AS (SELECT 'S' || n_regionkey || '.R' AS fqn, string_agg(n_name || ' ' || n_nationkey, ',' ORDER BY n_nationkey) AS cols FROM nation GROUP BY n_regionkey) SELECT 'TOP.' || fqn AS fqn, cols FROM c UNION ALL SELECT fqn, cols FROM c""")
def columns_by_object(spark, sf_dir):
    rows = t(spark, sf_dir, "nation").select(F.concat(F.lit("TOP.S"), "n_regionkey", F.lit(".R")).alias("fqn"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("type"))
    return catalog.grouped_columns(rows).select("fqn", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",").alias("cols"))


@query("SELECT c_name AS fqn, c_custkey % 2 = 0 AS is_local FROM customer")
def local_resources(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    found = c.select(F.col("c_mktsegment").alias("schema"), F.concat(F.lit("x."), "c_name").alias("fqn"))
    own = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("db.x."), F.lower("c_name")).alias("fqn"))
    return catalog.with_local(found, own).select(F.expr("substring(fqn, 3)").alias("fqn"), "is_local")


@query(f"WITH e AS ({FK}) SELECT (SELECT count(DISTINCT x) FROM (SELECT source AS x FROM e UNION ALL SELECT target FROM e)) AS n_nodes, count(*) * 2 AS n_edges, count(*) AS n_reads, 0::BIGINT AS n_writes FROM e")
def edge_stats(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    return graph.edge_stats(e.withColumn("type", F.lit("READS")).union(e.withColumn("type", F.lit("dependency"))))


@query(f"WITH e AS ({FK}) SELECT source AS fqn, 0::BIGINT AS n_reads, count(*) AS n_writes FROM e GROUP BY 1")
def edge_badges(spark, sf_dir):
    return graph.badges(fk_edges(spark, sf_dir).withColumn("type", F.lit("Writes")))


@query(f"WITH e AS ({FK}) SELECT source AS fqn FROM e WHERE target = 'nation:7' UNION SELECT 'nation:7' UNION SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey = 7")
def searched_view(spark, sf_dir):
    e = fk_edges(spark, sf_dir).withColumn("type", F.lit("dependency"))
    nodes = ends(e).withColumn("object_type", F.split_part("fqn", F.lit(":"), F.lit(1)))
    every = graph.view(nodes, e, node_types=["customer", "supplier", "nation", "region"], edge_types=["DEPENDENCY"])
    return graph.view(*every, search="Nation:7")[0].select("fqn")


@query("SELECT c_name AS fqn FROM customer WHERE c_name LIKE '%7%' ORDER BY 1 LIMIT 50")
def picked_names(spark, sf_dir):
    return graph.picked(t(spark, sf_dir, "customer").select(F.col("c_name").alias("fqn")), "7").select("fqn")


@query(f"WITH e AS ({FK}), n AS (SELECT DISTINCT source AS fqn FROM e UNION SELECT target FROM e) SELECT fqn, CASE WHEN fqn LIKE 'nation%' THEN 'KNOWN' WHEN fqn LIKE 'region%' THEN 'EXTERNAL' ELSE 'TOLD' END AS object_type FROM n")
def node_types(spark, sf_dir):
    e = fk_edges(spark, sf_dir).withColumn("object_type", F.lit("TOLD"))
    known = ends(e).where("fqn LIKE 'nation%'").withColumn("object_type", F.lit("KNOWN"))
    return graph.node_types(e, known)


@query(f"WITH e AS ({FK}) SELECT fqn, string_agg(target, ', ' ORDER BY target) AS deps FROM (SELECT DISTINCT source AS fqn, target FROM e UNION SELECT DISTINCT target, NULL FROM e WHERE target LIKE 'region%') GROUP BY 1")
def plan_lines(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    return report.plan_lines(ends(e).withColumn("level", F.lit(0)), e).select("fqn", "deps")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '000904 (42000): bad' || chr(10) || 'name ' || user_id ELSE '  File \"x\"' END AS message FROM events")
def plain_messages(spark, sf_dir):
    real = F.concat(F.lit("000904 (42000): bad\n\tat org.x.Y.z(Y.java:1)\n   ^^^\nname "), F.col("user_id").cast("string"), F.lit('\n  File "a.py", line 3\nTraceback (most recent call last)'))
    return t(spark, sf_dir, "events").select("event_id", report.plain_message(F.when(F.col("event_id") % 2 == 0, real).otherwise('  File "x"')).alias("message"))


@query("SELECT event_type AS status, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS with_code FROM events GROUP BY 1")
def deploy_counters(spark, sf_dir):
    message = F.when(F.col("event_id") % 2 == 0, "000904: no").otherwise("other 000904: no")
    return deploy.statuses(t(spark, sf_dir, "events").select(F.col("event_type").alias("status"), message.alias("error_message")))


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def history_succeeded(spark, sf_dir):
    return state.succeeded(t(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILED"))).select("event_id")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_passed, count(*) FILTER (o_orderstatus <> 'F') AS n_failed FROM orders")
def check_outcomes(spark, sf_dir):
    return report.outcomes(t(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("passed")))


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def group_tree_counts(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.tree(rows.withColumnRenamed("c_name", "name"), "r_name", "n_name", "c_mktsegment").select("r_name", "n_name", "c_mktsegment", "n")


@query("SELECT o_orderkey AS id, o_orderdate AS deployed_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def topk_report(spark, sf_dir):
    return state.listing(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("deployed_at")), 10)
