"""Route questions to domains and named queries, and look up fields and KPIs by phrase.

The word lists are small and fixed, so they become column expressions: a table of questions is
scored in one narrow pass, without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.vocabulary import DEFAULT_INTENT, DOMAIN_TERMS, INTENT_KEYWORDS


def _score(text: Column, terms: Sequence[tuple[str, int]]) -> Column:
    hits = [F.when(F.contains(text, F.lit(t)), F.lit(w)).otherwise(F.lit(0)) for t, w in terms]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def _first_best(scores: Sequence[tuple[str, Column]], default: Column) -> Column:
    """Name with the strictly largest positive score; the first declared wins a tie."""
    top = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    pick = F.when(top == 0, default)
    for name, s in scores:
        pick = pick.when(s == top, F.lit(name))
    return pick


def _with_scores(df: DataFrame, text: str, terms: dict[str, Sequence[tuple[str, int]]]) -> tuple[DataFrame, list]:
    low = df.withColumn("__q", F.lower(text))
    low = low.select("*", *[_score(F.col("__q"), t).alias(f"__s_{d}") for d, t in terms.items()])
    return low, [(d, F.col(f"__s_{d}")) for d in terms]


def _route(df: DataFrame, text: str, terms: dict, default: str, label: str) -> DataFrame:
    scored, scores = _with_scores(df, text, terms)
    total = reduce(lambda a, b: a + b, [s for _, s in scores])
    top = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    candidates = F.array(*[F.struct(F.lit(d).alias("name"), s.alias("score")) for d, s in scores])
    return scored.select(
        *df.columns,
        _first_best(scores, F.lit(default)).alias(label),
        F.coalesce(F.bround(F.try_divide(top, total) * 100), F.lit(0)).cast("int").alias("confidence"),
        (top == 0).alias("fallback"),
        F.array_sort(candidates, lambda a, b: b["score"] - a["score"]).alias("candidates"),
    )


def classify_questions(df: DataFrame, text: str = "text", terms: dict = DOMAIN_TERMS) -> DataFrame:
    """Adds domain, confidence, fallback and candidates (name, score; best first)."""
    return _route(df, text, terms, next(iter(terms)), "domain")


def route(df: DataFrame, keywords: dict[str, Sequence[str]], text: str = "text") -> DataFrame:
    """Unweighted form: one keyword list per connection; the first connection when nothing matches."""
    terms = {c: [(k, 1) for k in words] for c, words in keywords.items()}
    return _route(df, text, terms, next(iter(terms)), "connection")


def pick_intent(
    df: DataFrame, text: str = "text", domain: str = "domain", intents: dict = INTENT_KEYWORDS, default: dict = DEFAULT_INTENT
) -> DataFrame:
    """Adds ``intent``: the query of the row's domain with the most keywords in the question."""
    hits = F.lit(None).cast("array<int>")
    names = F.lit(None).cast("array<string>")
    for dom, queries in intents.items():
        scores = [_score(F.col("__q"), [(w, 1) for w in words]) for words in queries.values()]
        hits = F.when(F.col(domain) == dom, F.array(*scores)).otherwise(hits)
        names = F.when(F.col(domain) == dom, F.array(*[F.lit(q) for q in queries], F.lit(default[dom]))).otherwise(names)
    rows = df.withColumn("__q", F.lower(text)).withColumn("__h", hits)
    best = F.array_max("__h")  # array_position finds the first declared of equal scores
    at = F.when(best > 0, F.array_position("__h", best)).otherwise(F.lit(-1))
    return rows.withColumn("intent", F.element_at(names, at.cast("int"))).drop("__q", "__h")


def ask(
    spark: SparkSession, question: str, named: dict[str, dict[str, Callable[[], DataFrame]]], cap: int = 50
) -> tuple[DataFrame, dict]:
    """Route one question, run its named query, return the cleaned rows and how it was routed.

    ``named`` holds the queries by domain and intent; all of a domain's intents may be picked.
    """
    from gaugeworks.operators.business import clean_result

    asked = spark.createDataFrame([(question,)], "text string")
    r = pick_intent(classify_questions(asked)).first()
    answer = named[r["domain"]][r["intent"]]()
    total = answer.count()
    if r["fallback"]:
        note = f"Nothing in the question names a domain; took {r['domain'].title()} and ran the '{r['intent']}' query."
    else:
        note = f"Routed to {r['domain'].title()} ({r['confidence']}% match) and ran the '{r['intent']}' query."
    return clean_result(answer, cap), {
        "question": question, "domain": r["domain"], "intent": r["intent"], "confidence": r["confidence"],
        "fallback": r["fallback"], "candidates": [c.asDict() for c in r["candidates"]], "columns": answer.columns,
        "row_count": total, "truncated": total > cap, "explanation": note,
    }


def ask_all(questions: DataFrame, text: str = "text") -> DataFrame:
    """(domain, intent, questions, fallbacks): the queries that a table of questions needs, each once."""
    routed = pick_intent(classify_questions(questions, text), text)
    return routed.groupBy("domain", "intent").agg(F.count("*").alias("questions"), F.count_if("fallback").alias("fallbacks"))


# semantic lookup ---------------------------------------------------------------------------


def build_fields(spark: SparkSession, sources: Sequence[dict]) -> DataFrame:
    """(position, table, name, data_type, sensitive, aliases) from schema hints, in declared order."""
    rows = []
    for src in sources:
        for name, meta in (src.get("schema_hint") or {}).get("fields", {}).items():
            rows.append(
                (len(rows), src["name"], name, meta.get("type", "text"), bool(meta.get("sensitive")), list(meta.get("aliases", [])))
            )
    return spark.createDataFrame(
        rows, "position int, table string, name string, data_type string, sensitive boolean, aliases array<string>"
    )


def kpi_aliases(kpis: Sequence[tuple[str, str]]) -> dict[str, str]:
    """phrase -> KPI id: every full name, then the first two words of each name; later entries win."""
    names = {name.lower(): kid for kid, name in kpis}
    pairs = {" ".join(name.lower().split()[:2]): kid for kid, name in kpis if len(name.split()) > 1}
    return {**names, **pairs}


def find_field(terms: DataFrame, fields: DataFrame, aliases: dict[str, str] | None = None, term: str = "term") -> DataFrame:
    """Adds ``field`` and ``table``: first declared field whose name or alias is the term, else the
    field that the alias table leads to (followed once per link, cycles end without a match)."""
    phrases = (
        fields.select("position", "table", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("p"))
        .groupBy(F.lower("p").alias("__p"))
        .agg(F.min_by(F.struct("table", "name"), "position").alias("__f"))
    )
    links = {k.lower(): v.lower() for k, v in (aliases or {}).items()}

    def follow(start: str) -> list[str]:
        path = [start]
        while path[-1] in links and links[path[-1]] not in path:
            path.append(links[path[-1]])
        return path[1:]

    known = {r["__p"] for r in phrases.collect()}  # the phrases of a hand-written schema hint
    resolved = {p: next((x for x in follow(p) if x in known), None) for p in links if p not in known}
    low = F.lower(F.trim(term))
    target = low
    pairs = [F.lit(x) for p, x in resolved.items() if x for x in (p, x)]
    if pairs:
        target = F.coalesce(F.create_map(*pairs)[low], low)
    return (
        terms.withColumn("__p", target)
        .join(phrases, "__p", "left")
        .select(*terms.columns, F.col("__f.table").alias("table"), F.col("__f.name").alias("field"))
    )


def kpi_for_question(df: DataFrame, kpis: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds ``kpi_id``: first KPI whose full name is in the question, else first with any word of it.

    Every word is searched once, in order of the first KPI that has it, so the first found decides. A
    word that holds an earlier one needs no search: where it is, the earlier one is too. A full name
    is searched only where one of its words was found.
    """
    first: dict[str, str] = {}
    for kid, name in kpis:
        for word in name.lower().split():
            if not any(known in word for known in first):
                first[word] = kid
    low = F.col("__q")
    by_word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(k)) for w, k in first.items()])
    full = F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(k)) for k, n in kpis])
    rows = df.withColumn("__q", F.lower(text)).withColumn("__w", by_word)
    return rows.withColumn("kpi_id", F.when(F.col("__w").isNotNull(), F.coalesce(full, F.col("__w")))).drop("__q", "__w")
