import pytest
from pyspark.errors import PySparkValueError

from gaugeworks.operators import documents as docs
from gaugeworks.operators import governance as gov
from gaugeworks.operators import routing as rt
from gaugeworks.session import checkpoint_root
from gaugeworks.sources import readers as rd
from gaugeworks.sources.store import TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def rows(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,value\n2024-01-01,1.5\n2024-01-02,\n2024-01-03,NaN\n")
    got = rd.scan_csv(spark, "a.csv", "timestamp DATE, value DOUBLE", str(tmp_path)).orderBy("timestamp").collect()
    assert [r["value"] for r in got] == [1.5, None, None]
    assert dict(rd.scan_csv(spark, str(tmp_path / "a.csv")).dtypes)["value"] == "double"
    with pytest.raises(FileNotFoundError):
        rd.scan_csv(spark, "missing.csv", base_dir=str(tmp_path))


def test_connector_options():
    plain = rd.jdbc_options("jdbc:postgresql://h/db", "SELECT 1")
    assert plain["query"] == "SELECT 1" and "dbtable" not in plain
    wide = rd.jdbc_options("jdbc:mysql://h/db", "SELECT * FROM t", None, "id", 0, 1000, 16)
    assert wide["dbtable"] == "(SELECT * FROM t) AS src" and wide["numPartitions"] == "16" and "query" not in wide
    with pytest.raises(ValueError):
        rd.jdbc_options("jdbc:x", "SELECT 1", partition_column="id")
    assert rd.snowflake_options("acc", "u", "p", "w", "d", "s", "SELECT 1")["sfURL"].startswith("acc.")
    assert rd.kafka_options("h:9092", "t", per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    assert rd.mongo_options("mongodb://h", "d", "c")["collection"] == "c"
    with pytest.raises(ValueError):
        rd.scan_external(None, "sap", {})


def test_upsert(spark, store):
    assert store.upsert("t", rows(spark, []), ["k"]) == 0 and not store.exists("t")
    assert store.upsert("t", rows(spark, [(1, "a"), (2, "b")]), ["k"]) == 2
    assert store.upsert("t", rows(spark, [(2, "B"), (3, "c")]), ["k"]) == 2
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a"), (2, "B"), (3, "c")}
    with pytest.raises(PySparkValueError):
        store.upsert("t", rows(spark, [(4, "x"), (4, "y")]), ["k"])
    store.upsert("t", rows(spark, [(4, "x"), (4, "y")]), ["k"], dedupe_by="v")
    assert store.read("t").where("k = 4").first()["v"] == "y"


def test_upsert_with_only_key_columns(spark, store):
    store.upsert("t", rows(spark, [(1,), (2,)], "k long"), ["k"])
    store.upsert("t", rows(spark, [(2,), (3,)], "k long"), ["k"])
    assert sorted(r["k"] for r in store.read("t").collect()) == [1, 2, 3]


def test_upsert_writes_touched_buckets_only(spark, store):
    store.upsert("t", rows(spark, [(i, "a") for i in range(200)]), ["k"])
    before = set(store.folders("t"))
    store.upsert("t", rows(spark, [(9, "b")]), ["k"])
    assert len(before - set(store.folders("t"))) == 1
    assert store.read("t").count() == 200 and store.read("t").where("k = 9").first()["v"] == "b"
    data = rows(spark, [(1, "a"), (2, "a"), (1, "b")])
    store.upsert("p", data, ["k", "v"], partition=["v"])
    assert len(store.folders("p")) <= 2
    store.upsert("p", rows(spark, [(9, "a")]), ["k", "v"], partition=["v"])
    assert store.read("p").count() == 4


def test_upsert_keeps_columns_it_does_not_carry(spark, store):
    store.upsert("t", rows(spark, [(1, "a", 1.5), (2, "b", 2.5)], "k long, v string, w double"), ["k"])
    store.upsert("t", rows(spark, [(2, "B"), (3, "c")]), ["k"])
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a", 1.5), (2, "B", 2.5), (3, "c", None)}
    store.upsert("t", rows(spark, [(1, 7)], "k long, x long"), ["k"])
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a", 1.5, 7), (2, "B", 2.5, None), (3, "c", None, None)}


def test_text_keys_stay_text(spark, store):
    data = rows(spark, [("001", 1), ("2024-01-01", 2)], "k string, n long")
    for _ in range(2):
        store.upsert("t", data, ["k"], partition=["k"])
    assert store.read("t").dtypes[0] == ("k", "string")
    assert {tuple(r) for r in store.read("t").collect()} == {("001", 1), ("2024-01-01", 2)}


def test_empty_partitioned_table_can_be_read(spark, store):
    store.ensure_table("t", rows(spark, []))
    assert store.read("t").collect() == []
    store.upsert("t", rows(spark, [(1, "a")]), ["k"], partition=["k"])
    assert store.read("t").count() == 1


def test_null_keys_and_appended_rows(spark, store):
    for _ in range(2):
        store.upsert("t", rows(spark, [(None, "a"), (1, "b")]), ["k"])
    assert store.read("t").count() == 2
    store.append("t", rows(spark, [(2, "c"), (3, "d")]))
    store.upsert("t", rows(spark, [(3, "D")]), ["k"])
    assert {tuple(r) for r in store.read("t").collect()} == {(None, "a"), (1, "b"), (2, "c"), (3, "D")}


def test_late_rows_do_not_replace_newer_ones(spark, store):
    store.upsert("t", rows(spark, [(1, "new", 10), (2, "x", 1)], "k long, v string, seq long"), ["k"], "seq")
    store.upsert("t", rows(spark, [(1, "old", 5), (2, "y", 2)], "k long, v string, seq long"), ["k"], "seq")
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {(1, "new"), (2, "y")}


def test_vacuum_leaves_the_table(spark, store):
    for i in range(4):
        store.upsert("t", rows(spark, [(99, str(i))]), ["k"])
    assert store.vacuum("t") == 2
    assert [tuple(r) for r in store.read("t").collect()] == [(99, "3")] and store.vacuum("t") == 0


def test_stored_types(spark, store):
    df = spark.sql("SELECT 1Y a, 1.5F b, true c, timestamp'2024-01-01' d, date'2024-01-01' e, array(1) f, 1.5BD g")
    assert store.ensure_table("t", df) and not store.ensure_table("t", df)
    assert [t for _, t in store.read("t").dtypes] == ["bigint", "double", "boolean", "timestamp", "timestamp", "string", "string"]


def test_numeric_profile_rules(spark):
    df = rows(spark, [("1", "x"), (" 2 ", "3"), ("nan", "y"), (None, "z")], "a string, b string")
    got = {r["column"]: r for r in rd.numeric_profile(df).collect()}
    assert set(got) == {"a"}
    assert (got["a"]["count"], got["a"]["min"], got["a"]["max"]) == (3, 1.0, 2.0)


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)


def test_documents(spark):
    d = rows(spark, [("x", 5), ("x", None), (None, 7)], "g string, n int")
    assert d.where(docs.doc_match(d, {"n__lte": 0})).count() == 1
    assert d.where(docs.doc_match(d, {"g": None})).count() == 1
    assert docs.group_avg(d, "g", "n").collect()[0]["avg_n"] == 7.0
    with pytest.raises(PySparkValueError):
        docs.doc_aggregate(d, [{"$lookup": {}}])
    j = rows(spark, [(1, '{"b": 1}'), (2, '{"a": 2, "b": 3}')], "i int, j string")
    assert docs.docs_to_table(j, "j", "i").columns == ["i", "b", "a"]
    assert docs.docs_to_table(j, "j", "i", most=2).columns == ["i", "b", "a"]
    with pytest.raises(ValueError):
        docs.docs_to_table(j, "j", "i", most=1)
    compound = docs.doc_aggregate(d, [{"$group": {"_id": {"g": "$g"}, "n": {"$sum": 1}}}]).collect()
    assert {r["_id"] for r in compound} == {'{"g":"x"}', "{}"}


def test_column_policy_specificity():
    role = gov.Role("r", (gov.ColumnPolicy("*.salary", "mask"), gov.ColumnPolicy("hr.salary", "deny"), gov.ColumnPolicy("hr.*", "allow")))
    assert gov.column_policy(role, "hr", "salary").action == "deny"
    assert gov.column_policy(role, "pay", "salary").action == "mask"
    assert gov.column_policy(role, "pay", "name") is None
    rules = [("*", "redact"), ("*_id", "hash"), ("hr.s*", "mask"), ("hr.*", "allow"), ("salary", "deny"), ("hr.*", "hash")]
    role = gov.Role("r", tuple(gov.ColumnPolicy(*r) for r in rules))
    want = {("hr", "salary"): "deny", ("hr", "size"): "mask", ("hr", "user_id"): "allow", ("pay", "user_id"): "hash", ("pay", "x"): "redact"}
    assert {k: gov.column_policy(role, *k).action for k in want} == want


def test_two_writers_lose_no_rows(spark, tmp_path):
    """One writer commits between another's reading and committing: an upsert raises, an append starts over."""
    one, two = (TableStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.upsert("t", rows(spark, [(1, "a")]), ["k"])
    commit = one._commit

    def meanwhile(table, manifest):
        one._commit = commit
        two.append("t", rows(spark, [(2, "b")]))
        commit(table, manifest)

    one._commit = meanwhile
    with pytest.raises(RuntimeError):
        one.upsert("t", rows(spark, [(3, "c")]), ["k"])
    assert sorted(r.k for r in one.read("t").collect()) == [1, 2]
    one._commit = meanwhile
    one.append("t", rows(spark, [(4, "d")]))
    assert sorted(r.k for r in one.read("t").collect()) == [1, 2, 2, 4]


def test_enforce(spark):
    df = rows(spark, [(1, "DE"), (2, "FR"), (3, None)])
    cfg = gov.AccessConfig((gov.Role("r", (gov.ColumnPolicy("v", "mask", "'; --"),), (gov.RowPolicy("t*", "v = '${user.country}'"),)),), "none")
    out, report = gov.enforce(df, "t", cfg, gov.User("u", "r", {"country": "DE' OR '1'='1"}))
    assert out.count() == 0 and report.masked == {"v": "mask"}
    out, _ = gov.enforce(df, "t", cfg, gov.User("u", "r", {"country": "DE"}))
    assert [tuple(r) for r in out.collect()] == [(1, "'; --")]
    with pytest.raises(gov.AccessDenied):
        gov.enforce(df, "t", cfg, gov.User("u", "other"))
    blind = gov.AccessConfig((gov.Role("r", (gov.ColumnPolicy("t.*", "deny"),)),))
    with pytest.raises(gov.AccessDenied):
        gov.enforce(df, "t", blind, gov.User("u", "r"))


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 'update'", "WITH x AS (SELECT 1) INSERT INTO t SELECT 1"])
def test_write_statements_are_refused(spark, sql):
    with pytest.raises(PySparkValueError):
        gov.check_read_only(spark, sql)


def test_routing(spark):
    q = rows(spark, [(1, "Show suspicious transfers"), (2, "zzz"), (3, "Top product by ORDERS"), (4, "net profit margin")])
    got = rt.pick_intent(rt.classify_questions(q, "v"), "v").orderBy("k").collect()
    assert [(r["domain"], r["intent"]) for r in got] == [
        ("banking", "flagged_transfers"), ("retail", "total_sales"), ("retail", "top_products"), ("finance", "profit"),
    ]
    assert got[1]["fallback"] and got[1]["confidence"] == 0 and got[0]["confidence"] == 100


def test_kpi_lookup(spark):
    q = rows(spark, [(1, "what is our net promoter score"), (2, "any churn?"), (3, "qqq")])
    kpis = [("a", "Customer Churn Rate"), ("b", "Net Promoter Score")]
    assert [r["kpi_id"] for r in rt.kpi_for_question(q, kpis, "v").orderBy("k").collect()] == ["b", "a", None]
    assert rt.kpi_aliases([("a", "Churn Rate"), ("b", "Churn Rate Monthly")])["churn rate"] == "b"
