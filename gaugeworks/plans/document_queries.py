"""Documents, policies and question routing on the test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from gaugeworks.functions.kpi_catalog import CATALOG
from gaugeworks.functions.vocabulary import DEFAULT_INTENT, DOMAIN_TERMS, INTENT_KEYWORDS
from gaugeworks.operators import documents as docs
from gaugeworks.operators import governance as gov
from gaugeworks.operators import routing as rt
from gaugeworks.plans import bindings as b
from gaugeworks.plans.registry import ORACLE, QUERIES, query

DOCS = """docs AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
PATIENTS = """patients AS (SELECT 'p' || event_id AS name, CAST(json_extract_string(props, '$.k') AS INTEGER) AS age,
  event_type AS department, 'd' || (user_id % 7) AS diagnosis, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0
  THEN 'admitted' ELSE 'discharged' END AS status, value AS cost FROM events)"""


def _docs(spark, sf):
    return b.documents(spark, sf).drop("ts")


@query("doc_match", f"""WITH {DOCS} SELECT event_id, k FROM docs WHERE event_type = 'click' AND COALESCE(k, 0) >= 20 AND COALESCE(value, 0) <= 50""")
def _(spark, sf):
    d = _docs(spark, sf)
    return d.where(docs.doc_match(d, {"event_type": "click", "k__gte": 20, "value__lte": 50})).select("event_id", "k")


@query("doc_match_missing", f"WITH {DOCS} SELECT COUNT(*) AS n FROM docs")
def _(spark, sf):
    d = _docs(spark, sf)  # a field no document has: 0 in a range test, equal only to None
    return d.where(docs.doc_match(d, {"absent__lte": 0, "absent": None})).agg(F.count("*").alias("n"))


@query("group_count", f"WITH {DOCS} SELECT event_type, COUNT(*) AS count FROM docs GROUP BY 1")
def _(spark, sf):
    return docs.group_count(_docs(spark, sf), "event_type")


@query("group_avg", f"""WITH {DOCS} SELECT event_type, COUNT(*) AS count,
  ROUND(AVG(CAST(COALESCE(value, 0) AS DECIMAL(18,2))), 2) AS avg_value FROM docs GROUP BY 1""")
def _(spark, sf):
    return docs.group_avg(_docs(spark, sf), "event_type", "value")


@query("count_where_group", f"WITH {DOCS} SELECT event_type, COUNT(*) AS count FROM docs WHERE k >= 50 GROUP BY 1")
def _(spark, sf):
    return docs.count_where_group(_docs(spark, sf), {"k__gte": 50}, "event_type")


@query("doc_find", f"""WITH {DOCS} SELECT event_id, event_type, k FROM docs WHERE COALESCE(k, 0) <= 30
  ORDER BY COALESCE(k, 0) DESC, event_id LIMIT 40""")
def _(spark, sf):
    return docs.doc_find(_docs(spark, sf), {"k__lte": 30}, "k", True, 40, ["event_id", "event_type", "k"], ["event_id"])


@query("doc_aggregate", f"""WITH {DOCS} SELECT event_type AS kind, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, CAST(SUM(k) AS BIGINT) AS total
  FROM docs WHERE k > 10 AND event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def _(spark, sf):
    return docs.doc_aggregate(
        _docs(spark, sf),
        [
            {"$match": {"k": {"$gt": 10}, "event_type": {"$in": ["click", "view", "purchase"]}}},
            {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "low": {"$min": "$value"}, "high": {"$max": "$value"}, "total": {"$sum": "$k"}}},
            {"$sort": {"n": -1, "_id": 1}},
            {"$project": {"kind": "$_id", "n": 1, "low": 1, "high": 1, "total": 1}},
        ],
    )


@query("docs_to_table", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf):
    return docs.docs_to_table(b.table(spark, sf, "events").select("event_id", "props"), "props", "event_id")


@query("health_by_department", f"WITH {PATIENTS} SELECT department, COUNT(*) AS patients FROM patients GROUP BY 1")
def _(spark, sf):
    return docs.by_department(b.patients(spark, sf))


@query("health_avg_cost", f"""WITH {PATIENTS} SELECT department, COUNT(*) AS patients,
  ROUND(AVG(CAST(cost AS DECIMAL(18,2))), 2) AS avg_cost FROM patients GROUP BY 1""")
def _(spark, sf):
    return docs.avg_cost(b.patients(spark, sf))


@query("health_admissions", f"WITH {PATIENTS} SELECT department, COUNT(*) AS admitted FROM patients WHERE status = 'admitted' GROUP BY 1")
def _(spark, sf):
    return docs.admissions(b.patients(spark, sf))


@query("health_diagnosis_distribution", f"WITH {PATIENTS} SELECT diagnosis, COUNT(*) AS count FROM patients GROUP BY 1")
def _(spark, sf):
    return docs.diagnosis_distribution(b.patients(spark, sf))


@query("health_senior_patients", f"""WITH {PATIENTS} SELECT name, age, department, diagnosis FROM patients WHERE age >= 60
  ORDER BY age DESC, name LIMIT 15""")
def _(spark, sf):
    return docs.senior_patients(b.patients(spark, sf))


# policies ----------------------------------------------------------------------------------

ACCESS = gov.AccessConfig(
    roles=(
        gov.Role(
            "analyst",
            column_policies=(
                gov.ColumnPolicy("*.c_acctbal", "redact"),
                gov.ColumnPolicy("customer.c_name", "hash"),
                gov.ColumnPolicy("c_mkt*", "mask", "#-#"),
                gov.ColumnPolicy("c_phone*", "deny"),
                gov.ColumnPolicy("c_nationkey", "allow"),
            ),
            row_policies=(
                gov.RowPolicy("cust*", "c_mktsegment = '${user.segment}'"),
                gov.RowPolicy("*", "c_acctbal > 0"),
            ),
        ),
        gov.Role("viewer", column_policies=(gov.ColumnPolicy("customer.c_acct*", "deny"), gov.ColumnPolicy("*.c_name", "mask"))),
    ),
)


@query("enforce_policies", """SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, '#-#' AS c_mktsegment
  FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""")
def _(spark, sf):
    user = gov.User("u1", "analyst", {"segment": "BUILDING"})
    return gov.enforce(b.table(spark, sf, "customer"), "customer", ACCESS, user)[0]


@query("enforce_fallback_role", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return gov.enforce(b.table(spark, sf, "customer"), "customer", ACCESS, gov.User("u2", "unknown"))[0]


@query("enforce_missing_attribute", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = NULL")
def _(spark, sf):
    df, _report = gov.enforce(b.table(spark, sf, "customer"), "customer", ACCESS, gov.User("u3", "analyst"))
    return df.agg(F.count("*").alias("n"))


@query("read_only_sql", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1")
def _(spark, sf):
    return gov.read_only_sql(spark, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1;", {"nation": b.table(spark, sf, "nation")})


# routing -----------------------------------------------------------------------------------


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _term_values(terms) -> str:
    rows = [f"({i}, {_text(d)}, {_text(t)}, {w})" for i, (d, ts) in enumerate(terms.items()) for t, w in ts]
    return f"terms(pos, name, term, weight) AS (VALUES {', '.join(rows)})"


def _routed(terms, label: str) -> str:
    first = _text(next(iter(terms)))
    return f"""{_term_values(terms)}, q AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user'),
  s AS (SELECT conv_id, turn, pos, name, SUM(CASE WHEN contains(low, term) THEN weight ELSE 0 END) AS score FROM q, terms GROUP BY ALL),
  routed AS (SELECT conv_id, turn, CASE WHEN MAX(score) = 0 THEN {first} ELSE ARG_MAX(name, score * 100 - pos) END AS {label},
  CASE WHEN SUM(score) = 0 THEN 0 ELSE CAST(ROUND_EVEN(MAX(score) / SUM(score) * 100, 0) AS INTEGER) END AS confidence,
  MAX(score) = 0 AS fallback, STRING_AGG(name || ':' || CAST(score AS BIGINT), ', ' ORDER BY score DESC, pos) AS candidates FROM s GROUP BY 1, 2)"""


def _candidates_text(df):
    return df.drop("text").withColumn(
        "candidates", F.concat_ws(", ", F.transform("candidates", lambda c: F.concat(c["name"], F.lit(":"), c["score"].cast("string"))))
    )


@query("classify_questions", f"WITH {_routed(DOMAIN_TERMS, 'domain')} SELECT * FROM routed")
def _(spark, sf):
    return _candidates_text(rt.classify_questions(b.user_questions(spark, sf)))


CONNECTIONS = {
    "shop": ["order", "price", "customer", "product", "the"],
    "people": ["name", "who", "person", "email"],
    "code": ["function", "code", "python", "how"],
}


@query("route_questions", f"WITH {_routed({c: [(k, 1) for k in w] for c, w in CONNECTIONS.items()}, 'connection')} SELECT * FROM routed")
def _(spark, sf):
    return _candidates_text(rt.route(b.user_questions(spark, sf), CONNECTIONS))


_INTENT_ROWS = ", ".join(
    f"({_text(d)}, {i}, {_text(q)}, {_text(w)})"
    for d, qs in INTENT_KEYWORDS.items() for i, (q, ws) in enumerate(qs.items()) for w in ws
)
_DEFAULT_ROWS = ", ".join(f"({_text(d)}, {_text(q)})" for d, q in DEFAULT_INTENT.items())


@query("pick_intent", f"""WITH {_routed(DOMAIN_TERMS, 'domain')}, kw(domain, pos, intent, word) AS (VALUES {_INTENT_ROWS}),
  fallback_to(domain, intent) AS (VALUES {_DEFAULT_ROWS}),
  i AS (SELECT r.conv_id, r.turn, r.domain, pos, intent, COUNT(*) FILTER (contains(q.low, word)) AS score
  FROM routed r JOIN q USING (conv_id, turn) JOIN kw USING (domain) GROUP BY ALL)
  SELECT conv_id, turn, i.domain, CASE WHEN MAX(score) = 0 THEN ANY_VALUE(f.intent) ELSE ARG_MAX(i.intent, score * 100 - pos) END AS intent
  FROM i JOIN fallback_to f USING (domain) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rt.pick_intent(rt.classify_questions(b.user_questions(spark, sf))).select("conv_id", "turn", "domain", "intent")


NAMES = [(k.id, k.name) for k in CATALOG]
_KPI_ROWS = ", ".join(f"({i}, {_text(k)}, {_text(n.lower())})" for i, (k, n) in enumerate(NAMES))
_KPI_SQL = f"""kpis(pos, kpi_id, name) AS (VALUES {_KPI_ROWS}), words AS (SELECT pos, kpi_id, UNNEST(string_split_regex(name, '\\s+')) AS word FROM kpis)"""


@query("kpi_for_question", f"""WITH {_KPI_SQL}, q AS (SELECT doc_id, lower(text) AS low FROM documents),
  full_name AS (SELECT doc_id, ARG_MIN(kpi_id, pos) AS kpi_id FROM q JOIN kpis ON contains(low, name) GROUP BY 1),
  by_word AS (SELECT doc_id, ARG_MIN(kpi_id, pos) AS kpi_id FROM q JOIN words ON contains(low, word) GROUP BY 1)
  SELECT q.doc_id, COALESCE(f.kpi_id, w.kpi_id) AS kpi_id FROM q LEFT JOIN full_name f USING (doc_id) LEFT JOIN by_word w USING (doc_id)""")
def _(spark, sf):
    return rt.kpi_for_question(b.table(spark, sf, "documents").select("doc_id", "text"), NAMES).drop("text")


SOURCES = [
    {"name": "events", "schema_hint": {"fields": {
        "event_type": {"type": "text", "aliases": ["click", "purchase", "Signup"]},
        "value": {"type": "currency", "aliases": ["price", "cost"], "sensitive": True},
        "user": {"type": "id"},
    }}},
    {"name": "orders", "schema_hint": {"fields": {"status": {"aliases": ["state", "click"]}, "price": {"type": "currency"}}}},
]
LINKS = {"amount": "price", "fee": "amount", "view": "error", "error": "view"}


@query("find_field", """WITH t AS (SELECT event_type AS term, COUNT(*) AS n FROM events GROUP BY 1
  UNION ALL SELECT term, COUNT(*) FROM (SELECT UNNEST(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1),
  hint(term, "table", field) AS (VALUES ('click', 'events', 'event_type'), ('purchase', 'events', 'event_type'),
  ('signup', 'events', 'event_type'), ('event_type', 'events', 'event_type'), ('value', 'events', 'value'), ('price', 'events', 'value'), ('cost', 'events', 'value'), ('user', 'events', 'user'),
  ('status', 'orders', 'status'), ('state', 'orders', 'status'), ('amount', 'events', 'value'), ('fee', 'events', 'value'))
  SELECT term, n, "table", field FROM t LEFT JOIN hint USING (term)""")
def _(spark, sf):
    words = b.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    )
    kinds = b.table(spark, sf, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    terms = kinds.unionByName(words.groupBy("term").agg(F.count("*").alias("n")))
    return rt.find_field(terms, rt.build_fields(spark, SOURCES), LINKS)


@query("build_catalog", f"""WITH {_KPI_SQL}, phrases AS (SELECT pos, kpi_id, name AS phrase, 0 AS late FROM kpis
  UNION ALL SELECT pos, kpi_id, array_to_string(list_slice(string_split_regex(name, '\\s+'), 1, 2), ' '), 1 FROM kpis
  WHERE len(string_split_regex(name, '\\s+')) > 1),
  alias AS (SELECT phrase, ARG_MAX(kpi_id, late * 1000 + pos) AS kpi_id FROM phrases GROUP BY 1)
  SELECT phrase, kpi_id, COUNT(doc_id) AS mentions FROM alias LEFT JOIN documents ON contains(lower(text), phrase) GROUP BY 1, 2""")
def _(spark, sf):
    alias = rt.kpi_aliases(NAMES)
    low = F.lower("text")
    counts = b.table(spark, sf, "documents").agg(
        *[F.count_if(F.contains(low, F.lit(p))).alias(f"c{i}") for i, p in enumerate(alias)]
    )
    rows = [F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("kpi_id"), F.col(f"c{i}").alias("mentions")) for i, (p, k) in enumerate(alias.items())]
    return counts.select(F.inline(F.array(*rows)))


def named_queries(spark, sf) -> dict:
    """The report of every intent, by domain, as registered."""
    prefix = {"healthcare": "health"}
    return {
        domain: {intent: partial(QUERIES[f"{prefix.get(domain, domain)}_{intent}"], spark, sf) for intent in intents}
        for domain, intents in INTENT_KEYWORDS.items()
    }


@query("ask", ORACLE["retail_top_customers"])
def _(spark, sf):
    return rt.ask(spark, "Who is the best customer by orders?", named_queries(spark, sf))[0]


@query("ask_health", ORACLE["health_admissions"])
def _(spark, sf):
    return rt.ask(spark, "How many patients were admitted to the hospital?", named_queries(spark, sf))[0]


@query("ask_all", f"""WITH {_routed(DOMAIN_TERMS, 'domain')}, kw(domain, pos, intent, word) AS (VALUES {_INTENT_ROWS}),
  fallback_to(domain, intent) AS (VALUES {_DEFAULT_ROWS}),
  i AS (SELECT r.conv_id, r.turn, r.domain, r.fallback, pos, intent, COUNT(*) FILTER (contains(q.low, word)) AS score
  FROM routed r JOIN q USING (conv_id, turn) JOIN kw USING (domain) GROUP BY ALL),
  picked AS (SELECT conv_id, turn, i.domain, ANY_VALUE(i.fallback) AS fallback,
  CASE WHEN MAX(score) = 0 THEN ANY_VALUE(f.intent) ELSE ARG_MAX(i.intent, score * 100 - pos) END AS intent
  FROM i JOIN fallback_to f USING (domain) GROUP BY 1, 2, 3)
  SELECT domain, intent, COUNT(*) AS questions, COUNT(*) FILTER (fallback) AS fallbacks FROM picked GROUP BY 1, 2""")
def _(spark, sf):
    return rt.ask_all(b.user_questions(spark, sf))
