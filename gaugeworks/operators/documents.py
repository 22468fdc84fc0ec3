"""Queries over flat documents: rows whose fields may be missing (null)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def doc_match(df: DataFrame, where: dict | None) -> Column:
    """AND of ``field: value``, ``field__gte`` and ``field__lte``. A missing field counts as 0 in a
    range test and matches equality only against None."""
    tests = []
    for name, value in (where or {}).items():
        if name.endswith("__gte"):
            tests.append(F.coalesce(_field(df, name[:-5]), F.lit(0)) >= value)
        elif name.endswith("__lte"):
            tests.append(F.coalesce(_field(df, name[:-5]), F.lit(0)) <= value)
        else:
            tests.append(_field(df, name).eqNullSafe(F.lit(value)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def group_count(df: DataFrame, by: str, label: str = "count") -> DataFrame:
    return (
        df.groupBy(_field(df, by).alias(by))
        .agg(F.count("*").alias(label))
        .orderBy(F.desc(label), F.asc_nulls_first(by))
    )


def group_avg(df: DataFrame, by: str, value: str, count_label: str = "count", avg_label: str | None = None) -> DataFrame:
    avg_label = avg_label or f"avg_{value}"
    v = F.coalesce(_field(df, value), F.lit(0))
    return (
        df.groupBy(_field(df, by).alias(by))
        .agg(F.count("*").alias(count_label), F.round(F.avg(v), 2).alias(avg_label))
        .orderBy(F.desc(avg_label), F.asc_nulls_first(by))
    )


def count_where_group(df: DataFrame, where: dict, group: str, label: str = "count") -> DataFrame:
    return group_count(df.where(doc_match(df, where)), group, label)


def doc_find(
    df: DataFrame,
    where: dict | None = None,
    sort: str | None = None,
    desc: bool = False,
    limit: int | None = None,
    fields: Sequence[str] | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Filter, sort (a missing field sorts as 0), cut, project; all fields in name order by default."""
    out = df.where(doc_match(df, where))
    if sort:
        at = F.coalesce(_field(df, sort), F.lit(0))
        out = out.orderBy(at.desc() if desc else at.asc(), *tie_break)
    if limit:
        out = out.limit(limit)
    return out.select(*[_field(df, f).alias(f) for f in (fields or sorted(df.columns))])


# stage lists -------------------------------------------------------------------------------

_COMPARE = {
    "$gte": lambda c, v: c >= v,
    "$gt": lambda c, v: c > v,
    "$lte": lambda c, v: c <= v,
    "$lt": lambda c, v: c < v,
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$in": lambda c, v: c.isin(list(v)),
}
_FOLD = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}


def _operand(df: DataFrame, value) -> Column:
    return _field(df, value[1:]) if isinstance(value, str) and value.startswith("$") else F.lit(value)


def _stage_match(df: DataFrame, spec: dict) -> DataFrame:
    for name, test in spec.items():
        for op, value in (test if isinstance(test, dict) else {"$eq": test}).items():
            if op not in _COMPARE:
                raise PySparkValueError(f"unsupported test {op}")
            df = df.where(_COMPARE[op](_field(df, name), value))
    return df


def _stage_group(df: DataFrame, spec: dict) -> DataFrame:
    by = spec["_id"]
    if isinstance(by, dict):  # a compound id is returned as text
        ident = F.to_json(F.struct(*[_operand(df, v).alias(k) for k, v in by.items()]))
    else:
        ident = _operand(df, by)
    folds = []
    for name, fold in spec.items():
        if name == "_id":
            continue
        (op, value), = fold.items()
        if op not in _FOLD:
            raise PySparkValueError(f"unsupported fold {op}")
        folds.append(_FOLD[op](_operand(df, value)).alias(name))
    return df.groupBy(ident.alias("_id")).agg(*folds)


def doc_aggregate(df: DataFrame, stages: Sequence[dict]) -> DataFrame:
    """Apply ``$match``, ``$group``, ``$sort``, ``$limit`` and ``$project`` stages in order."""
    for stage in stages:
        (op, spec), = stage.items()
        if op == "$match":
            df = _stage_match(df, spec)
        elif op == "$group":
            df = _stage_group(df, spec)
        elif op == "$sort":
            df = df.orderBy(*[F.desc(c) if d < 0 else F.asc(c) for c, d in spec.items()])
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$project":
            df = df.select(
                *[_operand(df, v).alias(k) if isinstance(v, str) else F.col(k) for k, v in spec.items() if v]
            )
        else:
            raise PySparkValueError(f"unsupported stage {op}")
    return df


def docs_to_table(
    df: DataFrame, json_column: str, order_by: str, columns: Sequence[str] | None = None, most: int = 2000
) -> DataFrame:
    """JSON texts with differing keys as one table: a text column per key, in first-seen order.

    The columns of a table are part of its plan, so the key names reach the driver. More than ``most``
    of them are an error, none is left out: give ``columns``, or use :func:`docs_to_map`, which keeps
    any number of keys in the rows.
    """
    doc = F.from_json(json_column, "map<string,string>")
    kept = [c for c in df.columns if c != json_column]
    if columns is not None:
        return df.withColumn("__doc", doc).select(*kept, *[F.col("__doc")[c].alias(c) for c in columns])
    keys = (
        df.select(F.explode(F.map_keys(doc)).alias("k"), order_by)
        .groupBy("k")
        .agg(F.min(order_by).alias("first"))
        .orderBy("first", "k")
        .limit(most + 1)
        .collect()
    )
    if len(keys) > most:
        raise ValueError(f"the documents have more than {most} different keys; name the columns or use docs_to_map")
    return df.withColumn("__doc", doc).select(*kept, *[F.col("__doc")[r["k"]].alias(r["k"]) for r in keys])


def docs_to_map(df: DataFrame, json_column: str, out: str = "doc") -> DataFrame:
    """The JSON texts as a MAP column, for any number of differing keys."""
    return df.withColumn(out, F.from_json(json_column, "map<string,string>"))


# named patient queries ---------------------------------------------------------------------


def by_department(docs: DataFrame) -> DataFrame:
    return group_count(docs, "department", "patients")


def avg_cost(docs: DataFrame) -> DataFrame:
    return group_avg(docs, "department", "cost", "patients", "avg_cost")


def admissions(docs: DataFrame) -> DataFrame:
    return count_where_group(docs, {"status": "admitted"}, "department", "admitted")


def diagnosis_distribution(docs: DataFrame) -> DataFrame:
    return group_count(docs, "diagnosis", "count")


def senior_patients(docs: DataFrame) -> DataFrame:
    return doc_find(
        docs, {"age__gte": 60}, "age", True, 15, ["name", "age", "department", "diagnosis"], tie_break=["name"]
    )
