"""Run a query on Spark and its SQL on DuckDB and compare the rows, whatever their order."""

import math
from pathlib import Path

import duckdb


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "").replace("+00:00", "")
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _number(cell):
    try:
        return float(cell)
    except ValueError:
        return None


def _order(row):
    """Text first, then numbers to six digits, so that rows that differ in a last digit still line up."""
    numbers = [_number(c) for c in row]
    return [c for c, n in zip(row, numbers) if n is None], [f"{n:.6g}" for n in numbers if n is not None]


def _same(a, b):
    """Equal cells; a number may differ by one unit of the sixth decimal, where a mean lies on a tie."""
    return all(
        x == y or (None not in (_number(x), _number(y)) and math.isclose(_number(x), _number(y), rel_tol=1e-9, abs_tol=1.1e-6))
        for x, y in zip(a, b)
    )


def difference(df, con, sql):
    """None when equal, else a short description."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(sorted(got, key=_order), sorted(want, key=_order)) if not _same(g, w)]
    return f"{len(bad)} of {len(got)} rows differ; {sorted(df.columns)} {bad[:2]}" if bad else None
