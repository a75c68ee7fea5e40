"""One registered query per operator, over whole tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import hashing, text
from strata.operators import aggregates, align, collections, commits, dataset, diff, merge, rows, search
from strata.operators.ordinal import with_ordinal
from strata.plans.objects import BlobObject, MapObject
from strata.plans.repository import Repository, VersionedDataset
from strata.runtime import new_path, row_key, stable
from strata.sources import csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- inputs that stand for branches --------------------------------------------------------------------------------

ORDERS_B = """(SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
  FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 = 0)"""
PART_R = "(SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS _rid FROM part)"
PART_B = """(SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS _rid FROM part WHERE p_partkey % 97 <> 5)"""
SUPP_R = "(SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS _rid FROM supplier)"
NATION_R = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS _rid FROM nation)"
COMMITS = """(SELECT user_id AS key, event_type AS branch, event_id AS version, ts,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent1,
  CASE WHEN event_id % 7 = 0 THEN lag(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent2 FROM events)"""
HEADS = f"(SELECT key, branch, arg_max(version, (ts, version)) AS version FROM {COMMITS} GROUP BY key, branch)"


def orders_a(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def orders_b(s, d):
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    kept = o.where("o_orderkey % 11 <> 0").select("o_orderkey", status, "o_totalprice")
    return kept.union(o.where("o_orderkey % 13 = 0").select(F.col("o_orderkey") + 1000000000, "o_orderstatus", "o_totalprice"))


def part_r(s, d):
    return with_ordinal(table(s, d, "part"), ["p_partkey"])


def part_b(s, d):
    return with_ordinal(table(s, d, "part").where("p_partkey % 97 <> 5"), ["p_partkey"])


def supplier_r(s, d):
    return with_ordinal(table(s, d, "supplier"), ["s_suppkey"])


def nation_r(s, d):
    return with_ordinal(table(s, d, "nation"), ["n_nationkey"])


def commit_log(s, d):
    w = Window.partitionBy("key").orderBy("ts", "version")
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("branch"), F.col("event_id").alias("version"), "ts")
    return e.withColumn("parent1", F.lag("version").over(w)).withColumn("parent2", F.when(F.col("version") % 7 == 0, F.lag("version", 3).over(w)))


def heads(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("branch"), F.col("event_id").alias("version"), "ts")
    return commits.branch_heads(e, ["ts"])


# --- scans, projections, predicates --------------------------------------------------------------------------------


@query(f"SELECT _rid, p_name FROM {PART_R}")
def scan_column(s, d):
    return rows.get_column(part_r(s, d), "p_name")


@query("SELECT o_orderkey AS _rid, o_orderstatus FROM orders")
def get_column(s, d):
    return rows.get_column(table(s, d, "orders").withColumnRenamed("o_orderkey", "_rid"), "o_orderstatus")


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name")
def get_schema(s, d):
    return s.createDataFrame([(c,) for c in table(s, d, "orders").columns], "column_name string")


@query("""SELECT column_name, sum(('0x' || md5(o_orderkey || '|' || v)[1:13])::HUGEINT)::VARCHAR AS version FROM (SELECT o_orderkey, 'o_orderstatus' AS column_name, o_orderstatus AS v FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders) GROUP BY column_name""")
def get_table_columns(s, d):
    return _column_versions(table(s, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_rows_eq(s, d):
    return rows.select_rows(table(s, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_mktsegment = 'BUILDING'")
def exists_row(s, d):
    c = table(s, d, "customer")
    return c.where("c_mktsegment = 'BUILDING'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT count(*) AS n FROM lineitem")
def table_size(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, list_extract(string_split(p_name, ' '), 2) AS second, list_extract(string_split(p_name, ' '), 1 + p_partkey % 3) AS any FROM part")
def list_get(s, d):
    a = F.split("p_name", " ")
    beyond = F.when(F.col("p_partkey") % 3 == 0, collections.list_get(a, 0)).when(F.col("p_partkey") % 3 == 1, collections.list_get(a, 1)).otherwise(collections.list_get(a, 2))
    return table(s, d, "part").select("p_partkey", collections.list_get(a, 1).alias("second"), beyond.alias("any"))


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_brand = 'Brand#2' THEN p_type END AS type FROM part")
def map_get(s, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.col("p_brand"), F.col("p_type"))
    return table(s, d, "part").select("p_partkey", F.try_element_at(m, F.lit("brand")).alias("brand"), F.try_element_at(m, F.lit("Brand#2")).alias("type"))


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'widget') AS found FROM part")
def set_contains(s, d):
    return table(s, d, "part").select("p_partkey", F.array_contains(F.split("p_name", " "), "widget").alias("found"))


@query(f"SELECT _rid, p_name, (SELECT count(*) - 10 FROM part) AS more FROM {PART_R} WHERE _rid < 10")
def limit_preview(s, d):
    return rows.preview(rows.get_column(part_r(s, d), "p_name"))


@query("SELECT p_partkey, '*' || p_name AS result FROM part")
def map_column(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("*"), "p_name").alias("result"))


# --- versions and branches -----------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT key FROM {COMMITS}")
def list_keys(s, d):
    return commits.list_keys(commit_log(s, d))


@query(f"SELECT key, branch FROM {HEADS}")
def list_branches(s, d):
    return heads(s, d).select("key", "branch")


@query(f"SELECT c.key, c.branch, c.version, c.parent1, c.parent2 FROM {COMMITS} c JOIN {HEADS} h ON c.key = h.key AND c.version = h.version")
def get_branch_head(s, d):
    return commit_log(s, d).join(heads(s, d).select("key", "version"), ["key", "version"], "left_semi").select("key", "branch", "version", "parent1", "parent2")


@query("SELECT user_id AS key, event_id AS version, event_type AS branch, value FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)")
def get_version(s, d):
    e = table(s, d, "events")
    wanted = e.agg(F.floor(F.max("event_id") / 2).alias("w"))
    return e.join(F.broadcast(wanted), F.col("event_id") == F.col("w")).select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("branch"), "value")


@query(f"SELECT key, version FROM {COMMITS} c WHERE NOT EXISTS (SELECT 1 FROM {COMMITS} x WHERE x.key = c.key AND (x.parent1 = c.version OR x.parent2 = c.version))")
def latest_versions(s, d):
    return commits.latest_versions(commit_log(s, d)).select("key", "version")


@query(f"SELECT c.key, c.branch, c.version, h.version IS NOT NULL AS is_head FROM {COMMITS} c LEFT JOIN {HEADS} h ON c.key = h.key AND c.branch = h.branch AND c.version = h.version")
def is_branch_head(s, d):
    return commits.is_branch_head(heads(s, d), commit_log(s, d).select("key", "branch", "version"))


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS found FROM customer")
def exists_key(s, d):
    return commits.exists_keys(table(s, d, "events").select(F.col("user_id").alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key")))


@query(f"SELECT * FROM {HEADS} UNION ALL SELECT key, 'dev', version FROM {HEADS} WHERE branch = 'purchase'")
def branch_fork(s, d):
    return commits.fork(heads(s, d), "purchase", "dev")


@query(f"SELECT key, CASE WHEN branch = 'purchase' THEN 'bought' ELSE branch END AS branch, version FROM {HEADS}")
def rename_branch(s, d):
    return commits.rename(heads(s, d), "purchase", "bought")


@query(f"SELECT * FROM {HEADS} WHERE branch <> 'purchase'")
def delete_branch(s, d):
    return commits.delete_branch(heads(s, d), "purchase")


@query(f"SELECT a.key, a.version AS parent1, b.version AS parent2 FROM {HEADS} a JOIN {HEADS} b ON a.key = b.key WHERE a.branch = 'purchase' AND b.branch = 'click'")
def merge_commit(s, d):
    return commits.merge_commits(heads(s, d), "purchase", "click")


@query(f"SELECT key, version, branch, (parent1 IS NOT NULL)::INT + (parent2 IS NOT NULL)::INT AS n_parents FROM {COMMITS}")
def commit_meta(s, d):
    return commit_log(s, d).select("key", "version", "branch", (F.col("parent1").isNotNull().cast("int") + F.col("parent2").isNotNull().cast("int")).alias("n_parents"))


@query("""WITH RECURSIVE c AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS version FROM events),
a(key, version, distance) AS (SELECT key, max(version), 0 FROM c GROUP BY key UNION ALL SELECT key, version // 2, distance + 1 FROM a WHERE version // 2 > 0)
SELECT key, version::BIGINT AS version, distance FROM a""")
def ancestry(s, d):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long")
    c = table(s, d, "events").select(F.col("event_type").alias("key"), n.alias("version"))
    c = c.withColumn("parent1", F.when(F.floor(F.col("version") / 2) > 0, F.floor(F.col("version") / 2))).withColumn("parent2", F.lit(None).cast("long"))
    return commits.ancestry(c, c.groupBy("key").agg(F.max("version").alias("version")))


# --- diff, intersect -----------------------------------------------------------------------------------------------

KV = ["o_orderstatus", "o_totalprice"]
DUAL = f"""SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_orderstatus AS lhs_o_orderstatus, l.o_totalprice AS lhs_o_totalprice,
  r.o_orderstatus AS rhs_o_orderstatus, r.o_totalprice AS rhs_o_totalprice, l.o_orderkey IS NOT NULL AS in_lhs, r.o_orderkey IS NOT NULL AS in_rhs
  FROM orders l FULL JOIN {ORDERS_B} r ON l.o_orderkey = r.o_orderkey
  WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus OR l.o_totalprice IS DISTINCT FROM r.o_totalprice"""


@query(DUAL)
def map_dual_diff(s, d):
    return diff.dual_diff(orders_a(s, d), orders_b(s, d), ["o_orderkey"], KV)


_stored: dict[tuple[str, str, str], Repository] = {}


def stored(s, d, name: str, build: Callable[[Repository], None]) -> Repository:
    """A repository in the shared folder, built once per application and input: what is stored lasts from one query to the next."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _stored:
        repo = Repository(s, new_path(s, f"query-{name}"))
        build(repo)
        _stored[key] = repo
    return _stored[key]


def _orders_repo(repo: Repository, s, d) -> None:
    """Orders on master; dev as in ORDERS_B; hot with three rows changed and one gone."""
    repo.put("orders", orders_a(s, d), keys=["o_orderkey"])
    repo.branch("orders", "dev", old="master")
    repo.put("orders", orders_b(s, d), "dev", keys=["o_orderkey"])
    repo.branch("orders", "hot", old="master")
    few = orders_a(s, d).where("o_orderkey <> 5").withColumn("o_orderstatus", F.when(F.col("o_orderkey").isin(7, 70, 140), "X").otherwise(F.col("o_orderstatus")))
    repo.put("orders", few, "hot", keys=["o_orderkey"])


def orders_repo(s, d) -> Repository:
    return stored(s, d, "orders", lambda repo: _orders_repo(repo, s, d))


@query(DUAL.replace(ORDERS_B, "(SELECT o_orderkey, CASE WHEN o_orderkey IN (7, 70, 140) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey <> 5)"))
def pruned_diff(s, d):
    """Of two stored versions only the segments that differ are read."""
    return orders_repo(s, d).diff("orders", "master", "hot")


@query(DUAL)
def repository_diff(s, d):
    return orders_repo(s, d).diff("orders", "master", "dev")


@query(f"SELECT * FROM {ORDERS_B}")
def repository_get(s, d):
    return orders_repo(s, d).get("orders", "dev")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (3, 10, 77)")
def repository_lookup(s, d):
    repo = orders_repo(s, d)
    return repo.lookup(repo.commit("orders", repo.head("orders", "master"))["data"], s.createDataFrame([(3,), (10,), (77,), (-1,)], "o_orderkey bigint"))


@query(f"SELECT 'frame' AS kind, 3::BIGINT AS n_objects, true AS shared, (SELECT 2 * count(*) - 1 FROM orders) + (SELECT count(*) FROM {ORDERS_B}) AS n_rows")
def repository_storage(s, d):
    """Kinds, objects, and whether versions share segments; n_rows: of all versions."""
    repo = orders_repo(s, d)
    every = repo.segments().agg(F.count("*").alias("listed"), F.sum("n").alias("n_rows"))
    return repo.storage_info().join(F.broadcast(every)).select("kind", "n_objects", (F.col("n_segments") < F.col("listed")).alias("shared"), "n_rows")  # one row


@query("SELECT unnest(['dev', 'hot', 'master']) AS branch, unnest([1, 1, 0]) AS depth")
def repository_history(s, d):
    """How far each branch's head is from the first version."""
    repo = orders_repo(s, d)
    out = None
    for b in repo.list_branches("orders"):
        one = repo.history("orders", repo.head("orders", b)).agg(F.max("distance").alias("depth")).select(F.lit(b).alias("branch"), "depth")
        out = one if out is None else out.union(one)
    return out


@query("SELECT unnest(['dev', 'hot', 'master']) AS branch, unnest([true, true, false]) AS latest")
def repository_is_latest(s, d):
    repo = orders_repo(s, d)
    return s.createDataFrame([(b, repo.is_latest("orders", repo.head("orders", b))) for b in repo.list_branches("orders")], "branch string, latest boolean")


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders EXCEPT SELECT * FROM {ORDERS_B}")
def map_diff(s, d):
    return diff.map_diff(orders_a(s, d), orders_b(s, d), ["o_orderkey"], KV)


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders INTERSECT SELECT * FROM {ORDERS_B}")
def map_intersect(s, d):
    return diff.map_intersect(orders_a(s, d), orders_b(s, d), ["o_orderkey"], KV)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_diff(s, d):
    return diff.set_diff(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(s, d):
    return diff.set_intersect(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(f"SELECT l._rid, l.p_brand FROM {PART_R} l LEFT JOIN {PART_B} r ON l._rid = r._rid WHERE r._rid IS NULL OR l.p_brand IS DISTINCT FROM r.p_brand")
def list_diff(s, d):
    return diff.list_diff(part_r(s, d), part_b(s, d), "p_brand")


@query(f"SELECT l._rid, l.p_brand FROM {PART_R} l JOIN {PART_B} r ON l._rid = r._rid AND l.p_brand = r.p_brand")
def list_intersect(s, d):
    return diff.list_intersect(part_r(s, d), part_b(s, d), "p_brand")


LIST_DUAL = f"""SELECT coalesce(l._rid, r._rid) AS _rid, l.p_brand AS lhs_p_brand, r.p_brand AS rhs_p_brand, l._rid IS NOT NULL AS in_lhs, r._rid IS NOT NULL AS in_rhs
  FROM {PART_R} l FULL JOIN {PART_B} r ON l._rid = r._rid WHERE l._rid IS NULL OR r._rid IS NULL OR l.p_brand IS DISTINCT FROM r.p_brand"""


@query(LIST_DUAL)
def list_dual_diff(s, d):
    return diff.dual_diff(part_r(s, d), part_b(s, d), ["_rid"], ["p_brand"])


@query(LIST_DUAL)
def diff_column(s, d):
    return diff.dual_diff(rows.get_column(part_r(s, d), "p_brand"), rows.get_column(part_b(s, d), "p_brand"), ["_rid"], ["p_brand"])


@query(f"SELECT count(*) AS n_diff FROM ({LIST_DUAL})")
def diff_count(s, d):
    return aggregates.diff_count(part_r(s, d), part_b(s, d), "p_brand")


def _column_versions(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """column_name, version: an order-free digest of (key, value) sums, so that no task gathers a column."""
    h = lambda c: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(c)).cast("binary")), 1, 13), 16, 10).cast("decimal(38,0)")
    sums = df.agg(*[F.sum(h(c)).alias(c) for c in cols])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("version")) for c in cols])).alias("x")).select("x.*")


@query("SELECT unnest(['p_brand', 'p_type']) AS column_name, unnest([true, true]) AS in_lhs, unnest([true, false]) AS in_rhs")
def diff_table_columns(s, d):
    p = table(s, d, "part")
    lhs = _column_versions(p, "p_partkey", ["p_name", "p_brand", "p_type"])
    rhs = _column_versions(p.withColumn("p_brand", F.when(F.col("p_size") > 40, "Brand#X").otherwise(F.col("p_brand"))), "p_partkey", ["p_name", "p_brand"])
    return diff.dual_diff(lhs, rhs, ["column_name"], ["version"]).select("column_name", "in_lhs", "in_rhs")


def _entries(df: DataFrame) -> DataFrame:
    payload = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return dataset.with_hash(df.select(F.col("o_orderkey").cast("string").alias("entry"), payload.alias("payload")))


@query(f"""SELECT coalesce(l.o_orderkey, r.o_orderkey)::VARCHAR AS entry, l.o_orderkey IS NOT NULL AS in_lhs, r.o_orderkey IS NOT NULL AS in_rhs
  FROM orders l FULL JOIN {ORDERS_B} r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderstatus IS DISTINCT FROM r.o_orderstatus""")
def diff_dataset(s, d):
    out = dataset.diff_dataset(_entries(orders_a(s, d)), _entries(orders_b(s, d)))
    return out.select("entry", F.col("lhs").isNotNull().alias("in_lhs"), F.col("rhs").isNotNull().alias("in_rhs"))


@query(f"SELECT l._rid, l.p_name, r.p_brand, r.p_size FROM {PART_R} l JOIN {PART_R} r USING (_rid)")
def stitch_columns(s, d):
    p = part_r(s, d)
    return rows.stitch(rows.get_column(p, "p_name"), rows.get_column(p, "p_brand"), rows.get_column(p, "p_size"))


# --- three-way merge -----------------------------------------------------------------------------------------------

MERGE = """base AS (SELECT c_custkey AS k, round(c_acctbal) AS bal, c_mktsegment AS seg FROM customer),
a AS (SELECT k, CASE WHEN k % 7 = 0 THEN bal + 1 ELSE bal END AS bal, seg FROM base WHERE k % 17 <> 3),
b AS (SELECT k, CASE WHEN k % 14 = 0 THEN bal + 2 WHEN k % 21 = 0 THEN bal + 1 ELSE bal END AS bal, CASE WHEN k % 11 = 0 THEN 'B' ELSE seg END AS seg FROM base UNION ALL SELECT k + 1000000000, bal, seg FROM base WHERE k % 19 = 0),
j AS (SELECT coalesce(o.k, a.k, b.k) AS k, o.k IS NOT NULL AS in0, a.k IS NOT NULL AS in1, b.k IS NOT NULL AS in2, o.bal AS bal0, o.seg AS seg0, a.bal AS bal1, a.seg AS seg1, b.bal AS bal2, b.seg AS seg2,
  (o.k IS NULL) <> (a.k IS NULL) OR o.bal IS DISTINCT FROM a.bal OR o.seg IS DISTINCT FROM a.seg AS c1, (o.k IS NULL) <> (b.k IS NULL) OR o.bal IS DISTINCT FROM b.bal OR o.seg IS DISTINCT FROM b.seg AS c2,
  (a.k IS NULL) = (b.k IS NULL) AND a.bal IS NOT DISTINCT FROM b.bal AND a.seg IS NOT DISTINCT FROM b.seg AS same
  FROM base o FULL JOIN a ON o.k = a.k FULL JOIN b ON coalesce(o.k, a.k) = b.k)"""


def _merge_inputs(s, d):
    base = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    a = base.where("k % 17 <> 3").withColumn("bal", F.when(F.col("k") % 7 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    bal = F.when(F.col("k") % 14 == 0, F.col("bal") + 2).when(F.col("k") % 21 == 0, F.col("bal") + 1).otherwise(F.col("bal"))
    b = base.select("k", bal.alias("bal"), F.when(F.col("k") % 11 == 0, "B").otherwise(F.col("seg")).alias("seg"))
    return base, a, b.union(base.where("k % 19 = 0").withColumn("k", F.col("k") + 1000000000))


@query(f"WITH {MERGE} SELECT k, CASE WHEN c2 THEN bal2 ELSE bal1 END AS bal, CASE WHEN c2 THEN seg2 ELSE seg1 END AS seg FROM j WHERE NOT (c1 AND c2 AND NOT same) AND CASE WHEN c2 THEN in2 ELSE in1 END")
def map_merge3(s, d):
    return merge.merge3(*_merge_inputs(s, d), ["k"], ["bal", "seg"])


@query(f"WITH {MERGE} SELECT k, bal0 AS base_bal, seg0 AS base_seg, bal1 AS a_bal, seg1 AS a_seg, bal2 AS b_bal, seg2 AS b_seg FROM j WHERE c1 AND c2 AND NOT same")
def map_merge3_conflicts(s, d):
    return merge.conflicts(*_merge_inputs(s, d), ["k"], ["bal", "seg"])


@query(f"""WITH {MERGE}, r AS (SELECT *, c1 OR c2 AS ch, sum(CASE WHEN c1 OR c2 THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM j)
SELECT min(k) AS first_key, max(k) AS last_key FROM r WHERE ch GROUP BY run HAVING bool_or(c1) AND bool_or(c2) AND NOT bool_and(c1 AND c2 AND same)""")
def map_merge3_regions(s, d):
    return merge.region_conflicts(*_merge_inputs(s, d), "k", ["bal", "seg"])


@query(f"WITH {MERGE} SELECT k FROM j WHERE CASE WHEN in0 <> in2 THEN in2 ELSE in1 END")
def set_merge3(s, d):
    base, a, b = (x.select("k") for x in _merge_inputs(s, d))
    return merge.set_merge3(base, a, b, ["k"])


def _supplier_repo(repo: Repository, s, d) -> None:
    """Supplier on master; dev with s_acctbal one higher."""
    t = repo.table("supplier")
    t.create(supplier_r(s, d))
    t.fork("dev").put_column("s_acctbal", supplier_r(s, d).select("_rid", (F.col("s_acctbal") + 1).alias("s_acctbal")))


@query(f"SELECT _rid, s_suppkey, s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM {SUPP_R}")
def merge_table(s, d):
    def build(repo):
        _supplier_repo(repo, s, d)
        repo.table("supplier").merge_column("dev", "s_acctbal")

    return stored(s, d, "merge", build).table("supplier").read()


@query("""SELECT p_brand, count(*) AS lhs_n, count(*) FILTER (p_size % 10 <> 3) AS rhs_n FROM part GROUP BY p_brand""")
def list_align_sizes(s, d):
    """The stretches of an alignment cover both lists."""
    return list_align(s, d).groupBy("p_brand").agg(F.sum("lhs_n").alias("lhs_n"), F.sum("rhs_n").alias("rhs_n"))


@query()
def list_align(s, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(s, d, "part").select("p_brand", (F.row_number().over(w) - 1).alias("_rid"), F.col("p_type").alias("value"), "p_size")
    return align.align(p.drop("p_size"), p.where("p_size % 10 <> 3").drop("p_size"), "p_brand")


# --- collection edits ----------------------------------------------------------------------------------------------

WORDS = "string_split(p_name || ' ' || p_type, ' ')"


def _words():
    return F.split(F.concat_ws(" ", "p_name", "p_type"), " ")


def _list_query(name: str, expr, sql: str):
    QUERIES[name] = lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(expr(_words()), ",").alias("result"))
    SQL[name] = f"SELECT p_partkey, array_to_string({sql}, ',') AS result FROM (SELECT p_partkey, {WORDS} AS a FROM part)"


_list_query("list_splice", lambda a: collections.list_splice(a, 1, 2, F.array(F.lit("x"), F.lit("y"))), "a[:1] || ['x', 'y'] || a[4:]")
_list_query("list_insert", lambda a: collections.list_insert(a, 2, F.array(F.lit("x"))), "a[:2] || ['x'] || a[3:]")
_list_query("list_delete", lambda a: collections.list_delete(a, 1, 100), "a[:1]")
_list_query("list_append", lambda a: collections.list_append(a, F.array(F.lit("z"))), "a || ['z']")
_list_query("set_insert", lambda a: collections.set_insert(a, F.lit("widget")), "list_sort(list_distinct(a || ['widget']))")
_list_query("set_remove", lambda a: collections.set_remove(a, F.lit("widget")), "list_sort(list_distinct(list_filter(a, lambda x: x <> 'widget')))")


def _map_query(name: str, expr, sql: str):
    entries = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")

    def run(s, d):
        m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
        return table(s, d, "part").select("p_partkey", entries(expr(m)).alias("result"))

    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, {sql} AS result FROM part"


_map_query("map_set", lambda m: collections.map_set(m, F.lit("size"), F.lit("9")), "'brand=' || p_brand || ',size=9,type=' || p_type")
_map_query("map_multi_set", lambda m: collections.map_multi_set(m, F.create_map(F.lit("a"), F.lit("1"), F.lit("type"), F.lit("t"))), "'a=1,brand=' || p_brand || ',size=' || p_size || ',type=t'")
_map_query("map_remove", lambda m: collections.map_remove(m, F.lit("size")), "'brand=' || p_brand || ',type=' || p_type")


@query("SELECT doc_id, sha256(encode(text)[1:10] || 'ins'::BLOB || encode(text)[16:]) AS digest FROM documents")
def blob_splice(s, d):
    b = F.col("text").cast("binary")
    return table(s, d, "documents").select("doc_id", F.sha2(collections.blob_splice(b, 10, 5, F.lit("ins").cast("binary")), 256).alias("digest"))


@query("SELECT doc_id, sha256(encode(text)[101:300]) AS digest FROM documents")
def blob_read_range(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(collections.blob_read(F.col("text").cast("binary"), 100, 200), 256).alias("digest"))


@query(f"""SELECT _rid, n_name FROM {NATION_R} WHERE _rid < 5 UNION ALL SELECT r_regionkey + 5, r_name FROM region
UNION ALL SELECT _rid + (SELECT count(*) FROM region) - 3, n_name FROM {NATION_R} WHERE _rid >= 8""")
def list_splice_rows(s, d):
    ins = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("_rid"), F.col("r_name").alias("n_name"))
    return collections.rows_list_splice(nation_r(s, d).select("_rid", "n_name"), 5, 3, ins)


@query("""SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders GROUP BY o_custkey""")
def map_multi_set_rows(s, d):
    edits = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("n"))
    return collections.rows_map_set(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), edits, "k", "n")


@query("""SELECT l.v, l.times, p.p_partkey IS NOT NULL AS exists FROM (SELECT l_partkey AS v, count(*) AS times FROM lineitem GROUP BY l_partkey) l
LEFT JOIN part p ON p.p_partkey = l.v WHERE l.times > 1 OR p.p_partkey IS NOT NULL""")
def distinct_violations(s, d):
    return collections.distinct_violations(table(s, d, "lineitem").select(F.col("l_partkey").alias("v")), table(s, d, "part").select(F.col("p_partkey").alias("v")), "v")


# --- rows and columns of a table -----------------------------------------------------------------------------------

S_COLS = "_rid, s_suppkey, s_name, s_nationkey, s_acctbal"


@query(f"SELECT s.{S_COLS.replace(', ', ', s.')}, s._rid * 2 AS twice FROM {SUPP_R} s")
def put_column(s, d):
    t = supplier_r(s, d)
    return rows.put_column(t, "twice", t.select("_rid", (F.col("_rid") * 2).alias("twice")))


@query(f"SELECT _rid, s_suppkey, s_name, s_nationkey FROM {SUPP_R}")
def drop_column(s, d):
    return rows.drop_column(supplier_r(s, d), "s_acctbal")


@query(f"SELECT {S_COLS} FROM {SUPP_R} UNION ALL SELECT (SELECT count(*) FROM supplier), -1, 'new', 3, 1.5")
def insert_row(s, d):
    return rows.insert_row(supplier_r(s, d), {"s_suppkey": -1, "s_name": "new", "s_nationkey": 3, "s_acctbal": 1.5})


@query(f"""SELECT _rid, n_name FROM {NATION_R} UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey) - 1, r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""")
def insert_distinct(s, d):
    new = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("_rid"), F.col("r_name").alias("n_name"))
    return rows.insert_rows_distinct(nation_r(s, d).select("_rid", "n_name"), new, "n_name")


@query(f"SELECT _rid, s_suppkey, CASE WHEN _rid = 3 THEN 'three' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM {SUPP_R}")
def update_row_idx(s, d):
    return rows.update_row(supplier_r(s, d), 3, {"s_name": "three"})


@query(f"SELECT _rid, s_suppkey, CASE WHEN s_nationkey = 5 THEN 'five' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM {SUPP_R}")
def update_rows_eq(s, d):
    return rows.update_where(supplier_r(s, d), F.col("s_nationkey") == 5, {"s_name": "five"})


@query(f"""WITH p AS (SELECT _rid, p_partkey, p_size, p_size % 3 AS m FROM {PART_R}), f AS (SELECT min(_rid) AS a FROM p WHERE m = 1),
g AS (SELECT coalesce((SELECT min(_rid) FROM p, f WHERE _rid > a AND m <> 1) - 1, (SELECT max(_rid) FROM p)) AS z)
SELECT _rid, p_partkey, CASE WHEN _rid BETWEEN a AND z THEN -1 ELSE p_size END AS p_size, m FROM p, f, g""")
def update_first_run(s, d):
    p = part_r(s, d).select("_rid", "p_partkey", "p_size", (F.col("p_size") % 3).alias("m"))
    return rows.update_first_run(p, "m", 1, {"p_size": -1})


@query(f"SELECT CASE WHEN _rid > 4 THEN _rid - 1 ELSE _rid END AS _rid, s_suppkey, s_name, s_nationkey, s_acctbal FROM {SUPP_R} WHERE _rid <> 4")
def delete_row_idx(s, d):
    return rows.delete_row(supplier_r(s, d), 4)


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _rid, s_suppkey, s_name FROM supplier WHERE s_nationkey <> 5")
def delete_rows_eq(s, d):
    return rows.delete_rows(supplier_r(s, d), "s_nationkey", 5).select("_rid", "s_suppkey", "s_name")


def _tables(s, d) -> Repository:
    def build(repo):
        _supplier_repo(repo, s, d)
        dev = repo.table("supplier", "dev")
        dev.put_column("extra", supplier_r(s, d).select("_rid", F.lit("x").alias("extra")))
        repo.table("gone").create(supplier_r(s, d).select("_rid", "s_name").where("_rid < 3"))
        repo.table("gone").fork("dev")
        repo.table("gone").drop_all()

    return stored(s, d, "tables", build)


@query("SELECT unnest(['supplier', 'supplier', 'gone']) AS name, unnest(['master', 'dev', NULL]) AS branch")
def branch_table(s, d):
    repo = _tables(s, d)
    return s.createDataFrame([(n, b) for n in ("supplier", "gone") for b in repo.table(n).branches() or [None]], "name string, branch string")


@query("SELECT unnest(['s_name', 'extra', 'nope']) AS name, unnest([true, true, false]) AS anywhere, unnest([true, false, false]) AS on_master, unnest(['dev,master', 'dev', '']) AS branches")
def exists_column(s, d):
    t = _tables(s, d).table("supplier")
    return s.createDataFrame([(c, t.exists_column(c), t.exists_column(c, "master"), ",".join(t.column_branches(c))) for c in ("s_name", "extra", "nope")], "name string, anywhere boolean, on_master boolean, branches string")


@query("SELECT unnest(['supplier', 'gone', 'none']) AS name, unnest([true, false, false]) AS found, unnest([true, true, false]) AS key_lives")
def delete_table(s, d):
    """A table whose branches are all deleted is gone; its key and versions stay."""
    repo = _tables(s, d)
    return s.createDataFrame([(n, repo.table(n).exists(), repo.exists(n)) for n in ("supplier", "gone", "none")], "name string, found boolean, key_lives boolean")


@query(f"SELECT _rid, s_acctbal AS lhs_s_acctbal, s_acctbal + 1 AS rhs_s_acctbal FROM {SUPP_R}")
def table_diff(s, d):
    def build(repo):
        _supplier_repo(repo, s, d)

    return stored(s, d, "table-diff", build).table("supplier").diff("dev").select("_rid", "lhs_s_acctbal", "rhs_s_acctbal")


def _csv_folder(s, d) -> str:
    """Supplier as a CSV folder: header, then name|nation|key lines."""
    path = new_path(s, "query-csv")
    csv.dump_table(supplier_r(s, d).drop("s_acctbal"), path)
    return path


@query(f"SELECT _rid, s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM {SUPP_R}")
def load_table(s, d):
    return csv.load_table(s, _csv_folder(s, d))


@query(f"SELECT 0 AS line_no, 's_name|s_nationkey|s_suppkey' AS line UNION ALL SELECT _rid + 1, s_name || '|' || s_nationkey || '|' || s_suppkey FROM {SUPP_R}")
def dump_table(s, d):
    return csv.numbered_lines(s, _csv_folder(s, d)).select("line_no", "line")


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS _rid, l_orderkey, l_linenumber FROM lineitem")
def ordinals_in_ranges(s, d):
    """Numbered in ranges, as tables of more than a range's rows are."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return with_ordinal(table(s, d, "lineitem").select(*order), order, rows_per_part=4096).select("_rid", "l_orderkey", "l_linenumber")


@query(f"""SELECT row_number() OVER (ORDER BY place, kind, seq, pos) - 1 AS _rid, n_name FROM (
SELECT _rid AS place, 1 AS kind, 0 AS seq, 0 AS pos, n_name FROM {NATION_R} WHERE _rid NOT IN (2, 3, 10)
UNION ALL SELECT 2, 0, 0, r_regionkey, r_name FROM region UNION ALL SELECT 7, 0, 2, 0, 'second' UNION ALL SELECT 7, 0, 1, 0, 'first' UNION ALL SELECT 1000, 0, 4, 0, 'end')""")
def list_multi_splice(s, d):
    cuts = s.createDataFrame([(0, 2, 2), (1, 7, 0), (2, 7, 0), (3, 10, 1), (4, 1000, 0)], "seq int, start long, dels long")
    words = s.createDataFrame([(1, 0, "first"), (2, 0, "second"), (4, 0, "end")], "seq int, pos long, n_name string")
    ins = table(s, d, "region").select(F.lit(0).alias("seq"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("n_name")).unionByName(words)
    return collections.rows_multi_splice(nation_r(s, d).select("_rid", "n_name"), cuts, ins)


@query("""SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY place, p_partkey) - 1 AS _rid, value FROM (SELECT p_brand, 1 AS place, p_partkey, p_name AS value FROM part
UNION ALL SELECT DISTINCT p_brand, 0, 0, 'b first' FROM part UNION ALL SELECT DISTINCT p_brand, 2, 0, 'a last' FROM part)""")
def list_merge3(s, d):
    """Side a has put an element at each list's end, side b one at its start."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    base = table(s, d, "part").select("p_brand", (F.row_number().over(w) - 1).cast("long").alias("_rid"), F.col("p_name").alias("value"))
    a = base.unionByName(base.groupBy("p_brand").agg(F.count("*").alias("_rid")).withColumn("value", F.lit("a last")))
    b = base.withColumn("_rid", F.col("_rid") + 1).unionByName(base.select("p_brand").distinct().select("p_brand", F.lit(0).cast("long").alias("_rid"), F.lit("b first").alias("value")))
    return align.merge3(base, a, b, "p_brand")


@query("SELECT unnest(['a', 'c', 'd']) AS k, unnest(['9', '3', '4']) AS v")
def buffered_edit(s, d):
    """Several edits of a map as one version."""
    def build(repo):
        m = MapObject(repo, "m")
        m.create({"a": "1", "b": "2", "c": "3"})
        m.edit().set({"a": "5", "d": "4"}).delete("b").set({"a": "9"}).commit()

    return MapObject(stored(s, d, "buffered", build), "m").read().select("k", "v")


@query("SELECT sha256('0123456789'[1:3] || 'abc' || '0123456789'[6:] || 'end') AS digest, 14::BIGINT AS n, '2abc5' AS part")
def blob_object(s, d):
    def build(repo):
        b = BlobObject(repo, "b")
        b.create(b"0123456789", part_bytes=3)
        b.splice(3, 2, b"abc", part_bytes=3)
        b.append(b"end")

    b = BlobObject(stored(s, d, "blob", build), "b")
    whole = b.read().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda x: x["data"].cast("string")), "").alias("t"))
    return whole.select(F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("n"), F.lit(b.read_range(2, 5).decode()).alias("part"))


# --- datasets ------------------------------------------------------------------------------------------------------


def _lines(s, d):
    li = table(s, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag")
    return with_ordinal(li.select(*order, line.alias("line")), order, "line_no")


LINES = """(SELECT l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_returnflag AS line,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS line_no, l_orderkey || '^' || l_linenumber AS entry FROM lineitem)"""


@query(f"SELECT entry, arg_max(line, line_no) AS payload FROM {LINES} GROUP BY entry")
def dataset_from_csv(s, d):
    """The last line of a name holds; what orders the lines does, without numbering them."""
    li = table(s, d, "lineitem")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag")
    pos = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return dataset.entries_from_lines(li.select(line.alias("line"), pos.alias("pos")), [0, 1], no="pos").select("entry", "payload")


@query("SELECT o_orderkey || '^' || o_custkey AS entry FROM orders")
def entry_name(s, d):
    return table(s, d, "orders").select(text.entry_name(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("entry"))


def _orders_ds(s, d):
    return table(s, d, "orders").select(text.entry_name(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("entry"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("payload"), "o_orderkey")


DS = "(SELECT o_orderkey || '^' || o_custkey AS entry, o_orderkey || ',' || o_orderpriority AS payload, o_orderkey FROM orders)"


@query(f"SELECT entry, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE payload END AS payload FROM {DS} UNION ALL SELECT 'new^1', 'n'")
def put_entry(s, d):
    ds = _orders_ds(s, d)
    edits = ds.where("o_orderkey % 5 = 0").select("entry", F.lit("changed").alias("payload")).union(s.createDataFrame([("new^1", "n")], "entry string, payload string"))
    return dataset.put_entries(ds.select("entry", "payload"), edits)


@query(f"SELECT entry, payload FROM {DS} WHERE o_orderkey % 5 <> 0")
def delete_entry(s, d):
    ds = _orders_ds(s, d)
    return dataset.delete_entries(ds.select("entry", "payload"), ds.where("o_orderkey % 5 = 0").select("entry"))


@query(f"SELECT entry, payload FROM {DS} WHERE entry = (SELECT max(entry) FROM {DS})")
def get_entry(s, d):
    ds = _orders_ds(s, d)
    return ds.join(F.broadcast(ds.agg(F.max("entry").alias("entry"))), "entry", "left_semi").select("entry", "payload")


@query(f"SELECT c_custkey || '^' || c_custkey AS entry, c_custkey || '^' || c_custkey IN (SELECT entry FROM {DS}) AS found FROM customer")
def exists_entry(s, d):
    names = table(s, d, "customer").select(F.concat_ws("^", "c_custkey", "c_custkey").alias("entry"))
    return dataset.exists_entries(_orders_ds(s, d), names)


def _dataset_repo(s, d) -> Repository:
    """Orders as a dataset; dev has every fifth changed and every seventh deleted; another dataset was made and deleted."""
    def build(repo):
        ds = repo.dataset("orders")
        ds.create()
        rows_ = _orders_ds(s, d)
        ds.put(rows_.select("entry", "payload"))
        dev = ds.fork("dev")
        dev.put(rows_.where("o_orderkey % 5 = 0").select("entry", F.lit("changed").alias("payload")))
        dev.remove(rows_.where("o_orderkey % 7 = 0").select("entry"))
        for n in ("gone", "kept"):
            repo.dataset(n).create()
        repo.dataset("gone").drop()

    return stored(s, d, "dataset", build)


@query(f"SELECT entry, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE payload END AS payload, o_orderkey % 5 = 0 AS second FROM {DS} WHERE o_orderkey % 7 <> 0")
def dataset_put(s, d):
    """second: the entry has a version before."""
    return _dataset_repo(s, d).dataset("orders", "dev").read().select("entry", "payload", F.col("parent").isNotNull().alias("second"))


@query(f"SELECT DISTINCT 'orders' AS name, entry, CASE WHEN o_orderkey % 7 <> 0 THEN 'dev,master' ELSE 'master' END AS branches FROM {DS} WHERE o_orderkey IN (7, 8) UNION ALL SELECT 'orders', 'nope', ''")
def entry_branches(s, d):
    ds = _dataset_repo(s, d).dataset("orders")
    names = [r[0] for r in _orders_ds(s, d).where("o_orderkey IN (7, 8)").select("entry").distinct().collect()] + ["nope"]
    return s.createDataFrame([("orders", n, ",".join(ds.entry_branches(n))) for n in names], "name string, entry string, branches string")


@query("SELECT unnest(['kept', 'orders']) AS name, unnest([1, 2]) AS n_branches")
def list_dataset(s, d):
    repo = _dataset_repo(s, d)
    return s.createDataFrame([(n, len(repo.dataset(n).branches())) for n in VersionedDataset.names(repo)], "name string, n_branches int")


@query(f"SELECT pos, payload FROM (SELECT entry, payload, o_orderkey AS pos FROM {DS} WHERE o_orderkey IN (1, 2, 3))")
def dataset_select(s, d):
    names = [r[0] for r in _orders_ds(s, d).where("o_orderkey IN (1, 2, 3)").orderBy("o_orderkey").select("entry").collect()]
    return _dataset_repo(s, d).dataset("orders").select(names).select((F.col("pos") + 1).alias("pos"), "payload")


@query(f"SELECT entry, sha256(payload)[1:40] AS version, payload FROM {DS}")
def get_dataset(s, d):
    ds = _orders_ds(s, d).withColumn("version", F.substring(F.sha2("payload", 256), 1, 40))
    objects = ds.select("version", "payload").dropDuplicates(["version"])
    return dataset.dereference(ds.select("entry", "version"), objects)


@query(f"""SELECT n.pos, e.entry, e.payload FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem) n
JOIN {DS} e ON e.o_orderkey = n.l_orderkey""")
def select_entries(s, d):
    names = _lines(s, d).select(F.col("line_no").alias("pos"), "l_orderkey")
    ds = _orders_ds(s, d)
    named = names.join(ds.select("entry", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("pos", "entry")
    return dataset.select_entries(ds.select("entry", "payload"), named, check=False).select("pos", "entry", "payload")


@query(f"""SELECT l.entry, l.payload AS lhs, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'changed' END AS rhs FROM {DS} l WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def branch_dataset(s, d):
    """What a branch of the dataset has changed since it was made, read from the segments that differ."""
    repo = _dataset_repo(s, d)
    return repo.diff("orders", "master", "dev").select("entry", F.col("lhs_payload").alias("lhs"), F.col("rhs_payload").alias("rhs"))


@query(f"SELECT row_number() OVER (ORDER BY entry) - 1 AS line_no, payload FROM {DS}")
def export_dataset(s, d):
    return with_ordinal(_orders_ds(s, d).select("entry", "payload"), ["entry"], "line_no").select("line_no", "payload")


@query(f"SELECT count(*) AS n_entries, sum(strlen(payload) + 1)::BIGINT AS n_bytes FROM {DS}")
def export_stats(s, d):
    return dataset.export_stats(_orders_ds(s, d))


# --- aggregations --------------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (l_quantity = 1) AS matches, count(*) AS total FROM lineitem")
def count_where(s, d):
    return aggregates.count_where(table(s, d, "lineitem").select(F.col("l_quantity").cast("string").alias("q")), "q")


@query("SELECT _rid, ((p_partkey + p_size) // 2)::BIGINT AS average FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS _rid FROM part)")
def zip_average(s, d):
    p = part_r(s, d)
    return aggregates.zip_average(p.select("_rid", F.col("p_partkey").alias("v")), p.select("_rid", F.col("p_size").alias("v")))


@query("""SELECT source AS kind, count(*) AS n_chunks, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source
UNION ALL SELECT 'ALL', count(*), sum(strlen(text))::BIGINT FROM documents""")
def storage_info(s, d):
    return aggregates.storage_info(table(s, d, "documents").select(F.col("source").alias("kind"), F.octet_length("text").cast("long").alias("bytes")))


@query("""SELECT count(*) AS new_chunks, coalesce(sum(b), 0)::BIGINT AS new_bytes FROM (SELECT text, max(strlen(text)) AS b FROM documents WHERE source >= 'src5' GROUP BY text)
WHERE text NOT IN (SELECT text FROM documents WHERE source < 'src5')""")
def dedup_increment(s, d):
    t = table(s, d, "documents").select("source", hashing.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))
    return aggregates.dedup_increment(t.where("source < 'src5'"), t.where("source >= 'src5'"))


@query()
def histogram(s, d):
    return aggregates.histogram(s, 10, 1000, 0.3)


@query("SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, true AS whole FROM documents")
def chunk_bytes(s, d):
    """The chunks of a text, in order, are the text: their bytes add up, and their numbers run from 0. A text without bytes has no chunks."""
    docs = stable(table(s, d, "documents").select("doc_id", "text")).select("doc_id", row_key().alias("_row"), "text")  # a row each, whatever doc_ids repeat
    none = docs.select("doc_id", "_row", F.lit(None).cast("int").alias("chunk_no"), F.lit(0).cast("long").alias("n_bytes"))
    c = hashing.chunks(docs, "text", "doc_id", "_row").select(*none.columns).unionByName(none)
    whole = F.coalesce(F.max("chunk_no") == F.count("chunk_no") - 1, F.lit(True))
    return c.groupBy("_row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), whole.alias("whole")).drop("_row")


@query()
def chunk_dedup(s, d):
    c = hashing.chunks(table(s, d, "documents"), "text", "doc_id")
    return c.groupBy("chunk_hash").agg(F.count("*").alias("times"), F.max("n_bytes").alias("n_bytes"))


# --- keyword search ------------------------------------------------------------------------------------------------

INDEX = r"""(SELECT DISTINCT p_partkey AS entry, field, unnest(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM (
  SELECT p_partkey, 'ALL_FIELDS' AS field, p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type AS t FROM part UNION ALL
  SELECT p_partkey, 'p_name', p_name FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part))"""
FIELDS = ["p_name", "p_brand", "p_type"]


def _has(term: str, field: str = "ALL_FIELDS") -> str:
    return f"SELECT entry FROM {INDEX} WHERE field = '{field}' AND term = '{term}'"


@query(f"SELECT * FROM {INDEX}")
def inverted_index(s, d):
    return search.inverted_index(table(s, d, "part"), "p_partkey", FIELDS)


@query(f"{_has('widget')} UNION {_has('bolt')}")
def search_or(s, d):
    return search.search(table(s, d, "part"), "widget OR bolt", "p_partkey", FIELDS)


@query(f"{_has('widget')} INTERSECT {_has('large')}")
def search_and(s, d):
    return search.search_index(search.inverted_index(table(s, d, "part"), "p_partkey", FIELDS), "widget AND large")


@query(f"{_has('widget')} EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 3 = 1")
def stored_index(s, d):
    """A stored index brought up to date: every third entry lost the word, every third got it."""
    def build(repo):
        ds = repo.dataset("part")
        ds.create()
        repo.set_meta("part", "master", {"SCHEMA": "key,name"})
        p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("entry"), F.col("p_partkey").alias("n"), F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name").alias("payload"))
        ds.put(p.select("entry", "payload"))
        ds.index()
        ds.put(p.where("n % 3 = 0").select("entry", F.concat(F.col("entry"), F.lit(",plain")).alias("payload")))
        ds.put(p.where("n % 3 = 1").select("entry", F.concat(F.col("entry"), F.lit(",blue widget")).alias("payload")))

    return stored(s, d, "index", build).dataset("part").search("widget").select(F.col("entry").cast("long").alias("entry"))


@query(_has("12", "p_brand"))
def search_field(s, d):
    return search.search(table(s, d, "part"), "p_brand : 12", "p_partkey", FIELDS)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey AS entry, l_quantity FROM lineitem WHERE l_partkey IN ({_has('widget')})")
def query_join(s, d):
    names = search.search(table(s, d, "part"), "widget", "p_partkey", FIELDS)
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entry"), "l_quantity")
    return dataset.join_by_entries(names, li)[0]


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("SELECT event_id, array_to_string(string_split(props, '\"')[1:3], '_') AS f FROM events")
def split_fields(s, d):
    return table(s, d, "events").select("event_id", F.array_join(F.slice(text.split_fields(F.col("props"), '"'), 1, 3), "_").alias("f"))


@query(r"""SELECT event_id, array_to_string(list_filter(regexp_split_to_array(props, '[{}": ]'), lambda x: x <> ''), '_') AS tokens FROM events""")
def tokenize(s, d):
    return table(s, d, "events").select("event_id", F.array_join(text.tokenize(F.col("props"), '{}": '), "_").alias("tokens"))


@query("SELECT p_partkey, list_extract(string_split(p_name, ' '), 2) AS c, list_extract(string_split(p_name, ' '), 1) AS a FROM part")
def extract_elements(s, d):
    e = text.extract_elements(F.split("p_name", " "), [1, 0])
    return table(s, d, "part").select("p_partkey", e[0].alias("c"), e[1].alias("a"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s*(,)\s*', '\1', 'g')) AS h FROM documents")
def regularize_csv(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.regularize_csv(F.col("text")).cast("binary")).alias("h"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s+', '_', 'g')) AS h FROM documents")
def replace_space(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.replace_space(F.col("text"), "_").cast("binary")).alias("h"))


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(t, '(\.[0-9]*[1-9])0+\b', '\1', 'g'), '\.0+\b', '', 'g') AS f, regexp_replace(i, '\b0+([0-9])', '\1', 'g') AS i
FROM (SELECT o_orderkey, '1.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '00' AS t, lpad(o_orderkey::VARCHAR, 12, '0') AS i FROM orders)""")
def regularize_numbers(s, d):
    t = F.concat(F.lit("1."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("00"))
    i = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    return table(s, d, "orders").select("o_orderkey", text.regularize_floats(t).alias("f"), text.regularize_integers(i).alias("i"))


@query("SELECT doc_id, sha256(strlen(text) || ':' || text)[1:40] AS digest FROM documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (g * 5 + 1)::INT, 5))::BIGINT) >> b) & 31)::INT + 1, 1)), '')), '') AS version
  FROM (SELECT doc_id, sha256(strlen(text) || ':' || text)[1:40] AS h FROM documents)""")
def content_version(s, d):
    return table(s, d, "documents").select("doc_id", hashing.base32(hashing.content_hash(F.col("text"))).alias("version"))


@query(r"SELECT o_orderkey, o_orderkey || ':(' || o_orderstatus || ',' || CASE WHEN o_orderpriority = '1-URGENT' THEN '_' ELSE o_orderstatus END || ')' AS shown FROM orders")
def diff_text(s, d):
    rhs = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderstatus"))
    return table(s, d, "orders").select("o_orderkey", text.diff_text(F.col("o_orderkey"), F.col("o_orderstatus"), rhs).alias("shown"))


@query("SELECT event_id, k FROM (SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)")
def to_numbers(s, d):
    return table(s, d, "events").select("event_id", text.to_numbers(F.regexp_extract("props", "([0-9]+)", 1))[0].alias("k"))
