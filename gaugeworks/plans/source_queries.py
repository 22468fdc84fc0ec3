"""Sources, sinks and table profiles on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import query
from gaugeworks.session import checkpoint_root
from gaugeworks.sources import readers as rd
from gaugeworks.sources import store as st


def scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _orders(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch(spark, "csv")
    src = b.table(spark, sf, "customer")
    src.write.option("header", True).csv(path)
    return rd.scan_csv(spark, path, src.schema)


@query("scan_documents", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events""")
def _(spark, sf):
    path = scratch(spark, "json")
    src = b.table(spark, sf, "events").select(
        F.col("event_id").alias("_id"), "event_id", F.from_json("props", "k INT")["k"].alias("k"), "value"
    )
    src.write.json(path)
    return rd.scan_documents(spark, path, "_id LONG, event_id LONG, k INT, value DOUBLE")


@query("parse_documents", """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def _(spark, sf):
    return rd.parse_documents(b.table(spark, sf, "events").select("event_id", "event_type", "props"), "props", "k INT")


@query("scan_store", """SELECT o_orderstatus AS status, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM orders WHERE o_totalprice >= 1000 GROUP BY 1""")
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    store.append("history", _orders(spark, sf))
    return store.scan(
        """SELECT o_orderstatus AS status, count(*) AS n, double(sum(cast(o_totalprice AS decimal(18,2)))) AS amount
        FROM history WHERE o_totalprice >= :floor GROUP BY 1""",
        ["history"], {"floor": 1000},
    )


SHIFT = 7  # the updates are all orders again under a key moved by this much: most replace, some are new
UPDATES = f"""updates AS (SELECT o_orderkey + {SHIFT} AS o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders)"""


def _updates(spark, sf):
    return _orders(spark, sf).select(
        (F.col("o_orderkey") + SHIFT).alias("o_orderkey"), "o_custkey", F.lit("U").alias("o_orderstatus"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"),
    )


MERGED = f"""WITH {UPDATES}, existing AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)
  SELECT * FROM updates UNION ALL SELECT * FROM existing WHERE o_orderkey NOT IN (SELECT o_orderkey FROM updates)"""


@query("upsert_by_key", MERGED)
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    store.upsert("orders", _orders(spark, sf), ["o_orderkey"])
    store.upsert("orders", _updates(spark, sf), ["o_orderkey"])
    return store.read("orders")


@query("upsert_by_partition", """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN -1 ELSE o_custkey END AS v FROM orders""")
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    key, part = ["o_orderkey", "o_orderpriority"], ["o_orderpriority"]
    base = b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("v"))
    store.upsert("orders", base, key, partition=part)
    store.upsert("orders", base.where("o_orderpriority = '1-URGENT'").withColumn("v", F.lit(-1)), key, partition=part)
    return store.read("orders")


@query("upsert_keep_last", """SELECT user_id, CAST(MAX(event_id) AS BIGINT) AS event_id, ARG_MAX(event_type, event_id) AS event_type
  FROM events GROUP BY 1""")
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    store.upsert("latest", b.table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")
    return store.read("latest")


@query("append_rows", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    rows = b.table(spark, sf, "nation").select("n_nationkey", "n_name")
    store.append("nation", rows)
    store.append("nation", rows)
    return store.read("nation")


@query("ensure_table", """SELECT 'l_orderkey' AS name, 'bigint' AS type, COUNT(*) AS source_rows FROM lineitem
  UNION ALL SELECT 'l_linenumber', 'bigint', COUNT(*) FROM lineitem UNION ALL SELECT 'l_tax', 'double', COUNT(*) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'string', COUNT(*) FROM lineitem UNION ALL SELECT 'l_shipdate', 'timestamp', COUNT(*) FROM lineitem""")
def _(spark, sf):
    store = st.TableStore(spark, scratch(spark, "store"))
    like = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag", "l_shipdate")
    store.ensure_table("lines", like)
    types = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in store.read("lines").dtypes])
    return like.agg(F.count("*").alias("source_rows")).select(F.inline(types), "source_rows")


@query("ingest", f"""SELECT 'csv_orders' AS spec_id, 'orders' AS target_table, COUNT(*) AS rows_extracted, COUNT(*) AS rows_loaded FROM orders
  UNION ALL SELECT 'csv_shifted', 'orders', COUNT(*), COUNT(*) FROM orders
  UNION ALL SELECT '(total)', 'orders', COUNT(*) * 2, (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders UNION SELECT o_orderkey + {SHIFT} FROM orders)) FROM orders""")
def _(spark, sf):
    from gaugeworks.plans.jobs import run_ingestion

    store = st.TableStore(spark, scratch(spark, "store"))
    paths = {}
    for name, df in (("csv_orders", _orders(spark, sf)), ("csv_shifted", _updates(spark, sf))):
        paths[name] = scratch(spark, name)
        df.write.option("header", True).csv(paths[name])
    specs = [
        {"id": n, "kind": "csv", "path": p, "schema": _orders(spark, sf).schema, "target_table": "orders", "primary_key": ["o_orderkey"]}
        for n, p in paths.items()
    ]
    results = run_ingestion(store, specs)
    rows = [(r["spec_id"], r["target_table"], r["rows_extracted"], r["rows_loaded"]) for r in results]
    seen = spark.createDataFrame(rows, "spec_id string, target_table string, rows_extracted long, rows_loaded long")
    total = store.read("orders").agg(F.count("*").alias("rows_loaded")).select(
        F.lit("(total)").alias("spec_id"), F.lit("orders").alias("target_table"),
        F.lit(sum(r[2] for r in rows)).alias("rows_extracted"), "rows_loaded",
    )
    return seen.unionByName(total)


def _cols(con_table: str) -> str:
    return f"(SELECT STRING_AGG(column_name, ', ' ORDER BY ordinal_position) FROM (SELECT name AS column_name, cid AS ordinal_position FROM pragma_table_info('{con_table}')))"


_DESCRIBED = ("customer", "orders", "lineitem", "events")


@query("describe_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", COUNT(*) AS rows, {_cols(t)} AS columns FROM {t}" for t in _DESCRIBED
) + " UNION ALL SELECT '(all)', " + " + ".join(f"(SELECT COUNT(*) FROM {t})" for t in _DESCRIBED) + ", ''")
def _(spark, sf):
    return st.describe_tables({t: b.table(spark, sf, t) for t in _DESCRIBED})


@query("sample_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(spark, sf):
    return st.sample_table(_orders(spark, sf), ["o_orderkey"])


@query("list_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS rows FROM {t}" for t in ("customer", "supplier", "part", "orders")))
def _(spark, sf):
    out = st.describe_tables({t: b.table(spark, sf, t) for t in ("customer", "supplier", "part", "orders")})
    return out.where(F.col("table") != "(all)").select(F.col("table").alias("name"), "rows")


_PROFILE = ("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_suppkey")


@query("numeric_profile", """WITH cells AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS x FROM lineitem" for c in _PROFILE
) + """), s AS (SELECT "column", COUNT(*) AS n, COUNT(x) AS count, MIN(x) AS min, MAX(x) AS max, ROUND(SUM(x), 2) AS sum FROM cells GROUP BY 1)
  SELECT "column", count, min, max, sum, ROUND(sum / count, 6) AS avg FROM s WHERE count >= GREATEST(1, n // 2)""")
def _(spark, sf):
    out = rd.numeric_profile(b.table(spark, sf, "lineitem").select(*_PROFILE))
    return out.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round(F.col("sum") / F.col("count"), 6))


@query("preview", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey
  FROM customer ORDER BY customer.c_custkey LIMIT 25""")
def _(spark, sf):
    return rd.preview(b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])


@query("preview_size", f"SELECT COUNT(*) AS row_count, 5 AS column_count, {_cols('customer')} AS columns FROM customer")
def _(spark, sf):
    return rd.preview_size(b.table(spark, sf, "customer"))


@query("upsert_partial_columns", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def _(spark, sf):
    """Updates that carry one column leave the others as they are."""
    store = st.TableStore(spark, scratch(spark, "store"))
    base = _orders(spark, sf)
    store.upsert("orders", base, ["o_orderkey"])
    store.upsert("orders", base.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus")), ["o_orderkey"])
    return store.read("orders")


@query("upsert_text_partition", """SELECT LPAD(CAST(c_nationkey AS VARCHAR), 3, '0') AS nation, c_custkey, c_acctbal + CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END AS c_acctbal FROM customer""")
def _(spark, sf):
    """Keys such as '007' stay text and are found again by the second upsert."""
    store = st.TableStore(spark, scratch(spark, "store"))
    rows = b.table(spark, sf, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("nation"), "c_custkey", "c_acctbal"
    )
    key = ["nation", "c_custkey"]
    store.upsert("customers", rows, key, partition=["nation"])
    store.upsert("customers", rows.where("nation < '005'").withColumn("c_acctbal", F.col("c_acctbal") + 1), key, partition=["nation"])
    return store.read("customers")
