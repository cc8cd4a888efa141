"""Queries of operators on tables, states and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sqltext as S
from .operators import graph, quality, state
from .plans import report
from .plans.dialect import execute
from .plans.load import batch_id

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Checks ask for ordinals; here a key plus 2 stands for the row's place."""
    return df.withColumn("ordinal", F.col(key).cast("long") + 2)


VIEW = """SELECT c_custkey, c_name, count(o_orderkey) AS order_count, round(coalesce(sum(o_totalprice), 0), 2) AS total_amount, max(o_orderdate) AS last_order
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name"""


@query(VIEW)
def view_order_summary(spark, sf_dir):
    for name in ("customer", "orders"):
        t(spark, sf_dir, name).createOrReplaceTempView(name)
    return execute(spark, VIEW)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def view_filtered_projection(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey", "o_custkey")


@query("SELECT event_id + 2 AS ordinal, user_id, min(event_id + 2) OVER (PARTITION BY user_id) AS first_row FROM events QUALIFY event_id + 2 > min(event_id + 2) OVER (PARTITION BY user_id)")
def dq_unique_violations(spark, sf_dir):
    rows = numbered(t(spark, sf_dir, "events"), "event_id").withColumn("v", F.col("user_id").cast("string"))
    found = quality.unique(rows, "v")
    return found.join(rows, "ordinal").select("ordinal", "user_id", F.regexp_extract("message", r"first seen row (\d+)", 1).cast("long").alias("first_row"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeats, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys FROM lineitem")
def dq_unique_summary(spark, sf_dir):
    keys = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    return keys.agg((F.sum("count") - F.count("*")).alias("n_repeats"), F.count("*").alias("n_keys"))


@query("SELECT c_custkey + 2 AS ordinal FROM customer WHERE c_custkey % 7 IN (1, 2, 3)")
def dq_not_null_violations(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 7 == 1, " \t").when(F.col("c_custkey") % 7 == 2, "null").when(F.col("c_custkey") % 7 != 3, F.col("c_name"))
    return quality.not_null(numbered(t(spark, sf_dir, "customer"), "c_custkey").withColumn("v", value), "v").select("ordinal")


@query("SELECT o_orderkey + 2 AS ordinal FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL")
def dq_accepted_values(spark, sf_dir):
    return quality.accepted_values(numbered(t(spark, sf_dir, "orders"), "o_orderkey"), "o_orderstatus", ["F", "O"]).select("ordinal")


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{n}' AS test_case, count(*) BETWEEN 10 AND 100000 AS passed FROM {n}" for n in COUNTED))
def dq_row_count(spark, sf_dir):
    return quality.run(spark, [quality.Case(n, n, "row_count", min=10, max=100_000) for n in COUNTED], lambda n: t(spark, sf_dir, n)).select("test_case", "passed")


@query("SELECT o_orderkey + 2 AS ordinal FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def dq_relationship_orphans(spark, sf_dir):
    rows = numbered(t(spark, sf_dir, "orders"), "o_orderkey").withColumn("k", F.col("o_custkey").cast("string"))
    target = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("to"))
    return quality.relationship(rows, "k", target, "to").select("ordinal")


@query("SELECT o_orderkey + 2 AS ordinal FROM orders WHERE NOT (o_totalprice > 100000 AND length(o_orderpriority) >= 5)")
def dq_expression(spark, sf_dir):
    rows = numbered(t(spark, sf_dir, "orders"), "o_orderkey").select("ordinal", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"))
    return quality.expression(rows, "float(price) > 100000 and len(priority) >= 5").select("ordinal")


@query("SELECT o_orderkey + 2 AS ordinal FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND length(o_orderpriority) >= 5, false)")
def dq_sql_expression(spark, sf_dir):
    return quality.sql_expression(numbered(t(spark, sf_dir, "orders"), "o_orderkey"), "o_totalprice > 100000 AND length(o_orderpriority) >= 5").select("ordinal")


@query("""SELECT 'status' AS test_case, count(*) = 0 AS passed, count(*) AS n_failing FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'key', count(*) = count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'filled', count(*) = 0, count(*) FROM orders WHERE trim(o_orderpriority) = '' UNION ALL SELECT 'lost', false, 0""")
def dq_report(spark, sf_dir):
    C = quality.Case
    cases = [C("status", "orders", "accepted_values", "o_orderstatus", ["F", "O"]), C("key", "orders", "unique", "o_orderkey"), C("filled", "orders", "not_null", "o_orderpriority"), C("lost", "orders", "unique", "nowhere")]
    return quality.run(spark, cases, lambda n: numbered(t(spark, sf_dir, n), "o_orderkey").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))).select("test_case", "passed", "n_failing")


@query("SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_success_per_key(spark, sf_dir):
    return state.latest(t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts"), "user_id", F.col("ts"), F.col("event_id"))


@query("SELECT doc_id, md5(text) AS checksum FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0")
def changed_set(spark, sf_dir):
    now = t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("checksum"))
    last = now.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("checksum")).alias("checksum"))
    return state.changed(now, last, "doc_id")


def _lifecycle(spark, sf_dir) -> tuple[DataFrame, Column]:
    old, at = F.lit("2020-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    gone = F.col("c_custkey") % 5 == 0
    table = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_name").alias("object_fqn"), F.lit("TABLE").alias("object_type"), F.lit("a.sql").alias("file_path"), old.alias("first_deployed_at"), old.alias("last_deployed_at"),
        F.when(gone, old).alias("retired_at"), F.when(gone, "DROPPED").alias("retired_reason"), F.when(gone, "RETIRED").otherwise("ACTIVE").alias("status"),
    )
    return table, at


@query("""SELECT c_name AS object_fqn, CASE WHEN c_custkey % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END AS object_type, CASE WHEN c_custkey % 3 = 0 THEN 'b.sql' ELSE 'a.sql' END AS file_path,
  CASE WHEN c_custkey % 2 = 0 THEN 2020 ELSE 2024 END AS first_year, CASE WHEN c_custkey % 3 = 0 THEN 2024 ELSE 2020 END AS last_year,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'DROPPED' END AS retired_reason, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS status
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def lifecycle_upsert(spark, sf_dir):
    table, now = _lifecycle(spark, sf_dir)
    new = t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("object_fqn"), F.lit("VIEW").alias("object_type"), F.lit("b.sql").alias("file_path"))
    return state.upsert(table, new, now).select("object_fqn", "object_type", "file_path", F.year("first_deployed_at").alias("first_year"), F.year("last_deployed_at").alias("last_year"), "retired_reason", "status")


@query("""SELECT c_name AS object_fqn, CASE WHEN c_custkey % 5 = 0 THEN 'DROPPED' WHEN c_custkey % 3 <> 0 THEN 'REMOVED' END AS retired_reason,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 <> 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS status FROM customer WHERE c_custkey % 2 = 0""")
def lifecycle_retire(spark, sf_dir):
    table, now = _lifecycle(spark, sf_dir)
    current = t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("fqn"))
    return state.retire(table, state.removed(table, current, current.limit(0)), "REMOVED", now).select("object_fqn", "retired_reason", "status")


FK = """SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation"""
TREE = "SELECT p_partkey AS s, p_partkey // 2 AS d FROM part WHERE p_partkey // 2 > 0 AND p_partkey <> p_partkey // 2"


def fk_edges(spark, sf_dir) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c)).cast("string")
    pairs = (("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("nation", "n_nationkey", "n_regionkey", "region"))
    parts = [t(spark, sf_dir, n).select(key(n, a).alias("source"), key(to, b).alias("target")) for n, a, b, to in pairs]
    return parts[0].union(parts[1]).union(parts[2])


def tree_edges(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target")).where("target > 0 AND source <> target")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("fqn")).union(edges.select("target")).distinct()


@query(f"WITH e AS ({FK}) SELECT source, target, 'dependency' AS type FROM e UNION ALL SELECT source, target, 'reads' FROM e WHERE source LIKE 'nation%' UNION ALL SELECT target, source, 'writes' FROM e WHERE source LIKE 'supplier%'")
def snapshot_edges(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    v = ends(e).withColumn("object_type", F.lit("TABLE"))
    objects = v.join(e.groupBy(F.col("source").alias("fqn")).agg(F.collect_list("target").alias("dependencies")), "fqn", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    reads = e.where("source LIKE 'nation%'").select(F.col("source").alias("object_fqn"), F.array("target").alias("sources"), none.alias("targets"))
    writes = e.where("source LIKE 'supplier%'").select(F.col("target").alias("object_fqn"), none.alias("sources"), F.array("source").alias("targets"))
    return graph.all_edges(objects, reads.union(writes)).select("source", "target", "type")


@query(f"WITH RECURSIVE e AS ({FK}), l AS (SELECT DISTINCT target AS fqn, 0 AS level FROM e WHERE target LIKE 'region%' UNION SELECT e.source, l.level + 1 FROM e JOIN l ON e.target = l.fqn) SELECT fqn, max(level)::INT AS level FROM l GROUP BY fqn")
def fk_topo_levels(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    return graph.topo_levels(ends(e), e)


@query(f"WITH RECURSIVE e AS ({TREE}), c AS (SELECT s AS vertex FROM e WHERE d = 3 UNION SELECT e.s FROM e JOIN c ON e.d = c.vertex) SELECT vertex FROM c")
def closure_dependents(spark, sf_dir):
    return graph.closure(tree_edges(spark, sf_dir), spark.createDataFrame([(3,)], "v long"))


@query(f"""WITH RECURSIVE e AS ({TREE}), b AS (SELECT s AS x, d AS y FROM e UNION ALL SELECT d, s FROM e), k AS (SELECT 5::BIGINT AS v, 0 AS n UNION SELECT y, n + 1 FROM k JOIN b ON x = v WHERE n < 3)
SELECT DISTINCT v::VARCHAR AS fqn FROM k""")
def khop_subgraph(spark, sf_dir):
    e = tree_edges(spark, sf_dir).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    v = ends(e).withColumn("object_type", F.lit("TABLE"))
    return graph.subgraph(v, e, e.limit(0).withColumn("type", F.lit("reads")), "5", 3, "both")[0].select("fqn")


@query(f"WITH e AS ({FK}) SELECT source AS vertex, count(*) AS n FROM e GROUP BY 1")
def in_degree(spark, sf_dir):
    return graph.in_degree(fk_edges(spark, sf_dir))


@query(f"WITH e AS ({FK}) SELECT target AS ref, count(DISTINCT source) AS n FROM e GROUP BY 1")
def reverse_index(spark, sf_dir):
    return graph.reverse_index(fk_edges(spark, sf_dir)).select("ref", F.size("objects").cast("long").alias("n"))


@query(f"""WITH RECURSIVE e AS ({TREE} UNION ALL SELECT 1, 199), a AS (SELECT s AS x, d AS y FROM e UNION SELECT a.x, e.d FROM a JOIN e ON a.y = e.s) SELECT DISTINCT x AS fqn FROM a WHERE x IN (SELECT x FROM a WHERE x = y)""")
def cycle_members(spark, sf_dir):
    e = tree_edges(spark, sf_dir).union(spark.createDataFrame([(1, 199)], "source long, target long"))
    return graph.on_cycles(ends(e), e)


@query(f"WITH RECURSIVE e AS ({TREE}), l AS (SELECT 1::BIGINT AS fqn, 0 AS layer UNION SELECT e.s, l.layer + 1 FROM e JOIN l ON e.d = l.fqn) SELECT fqn, max(layer)::INT AS layer FROM l GROUP BY fqn")
def longest_path_layer(spark, sf_dir):
    e = tree_edges(spark, sf_dir)
    return graph.layers(ends(e), e)


@query(f"WITH e AS ({FK}) SELECT target AS source, source AS target, 'reads' AS type FROM e")
def data_flow(spark, sf_dir):
    return graph.data_flow(fk_edges(spark, sf_dir).withColumn("type", F.lit("READS")))


@query("SELECT md5(text) AS checksum, count(*) AS n FROM documents GROUP BY 1")
def checksum(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("checksum")).agg(F.count("*").alias("n"))


@query("SELECT page_id, upper(split_part(url, '/', 3)) AS fqn FROM pages")
def name_resolve(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", S.resolved(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("s")).alias("fqn"))


HINT_ROWS = ", ".join("('{}', '{}')".format(code, hint.replace("'", "''")) for code, hint in report.HINTS.items())


@query(f"""SELECT event_id, code, hint FROM (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE ([{', '.join(repr(c) for c in (*report.CODES, '123456'))}])[event_id % 13 + 1] END AS code FROM events)
LEFT JOIN (VALUES {HINT_ROWS}) h(c, hint) ON c = code""")
def error_parse(spark, sf_dir):
    code = F.element_at(F.array(*(F.lit(c) for c in (*report.CODES, "123456"))), (F.col("event_id") % 13 + 1).cast("int"))
    message = F.when(F.col("event_id") % 3 == 0, F.concat(code, F.lit(" (42000): x"))).when(F.col("event_id") % 3 == 1, F.concat(code, F.lit(": y"))).otherwise("no code")
    return report.hinted(t(spark, sf_dir, "events").select("event_id", message.alias("message"))).select("event_id", "code", "hint")


@query("SELECT batch, count(*) AS n FROM (SELECT o_orderkey // 1000 AS batch FROM orders) GROUP BY 1")
def batch_ids(spark, sf_dir):
    return numbered(t(spark, sf_dir, "orders"), "o_orderkey").groupBy(batch_id(F.col("ordinal")).alias("batch")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'it''s ' || n_name END AS v, CASE WHEN n_nationkey % 4 = 0 THEN 'NULL' ELSE '''it''''s ' || n_name || '''' END AS sql FROM nation")
def csv_values(spark, sf_dir):
    from .plans.load import as_value, literal

    raw = F.when(F.col("n_nationkey") % 8 == 0, "").when(F.col("n_nationkey") % 4 == 0, "Null").otherwise(F.concat(F.lit("it's "), F.col("n_name")))
    return t(spark, sf_dir, "nation").withColumn("raw", raw).select(F.col("n_nationkey").cast("string").alias("n_nationkey"), as_value(F.col("raw")).alias("v"), literal(F.col("raw")).alias("sql"))
