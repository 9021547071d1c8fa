"""Result assertions: a small language on a query's rows, evaluated by Spark aggregates, and run metrics."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.relational import nearest_rank

_OPS = {"==": lambda a, b: a == b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
_OP = r"(==|!=|<>|>=|<=|=|>|<)"


@dataclass(frozen=True)
class Clause:
    kind: str  # count, count_col, cell, in, not_in, column
    column: str | None = None
    op: str | None = None
    value: object = None
    cell: tuple[int, int] | None = None


def _value(text: str):
    t = text.strip()
    if len(t) > 1 and t[0] in "'\"" and t[-1] == t[0]:
        return t[1:-1]
    try:
        return int(t)
    except ValueError:
        try:
            return float(t)
        except ValueError:
            return t


def parse_clause(text: str) -> Clause:
    t = text.strip()
    if m := re.fullmatch(rf"COUNT\(\s*\*\s*\)\s*{_OP}\s*(.+)", t, re.I):
        return Clause("count", op=m[1], value=_value(m[2]))
    if m := re.fullmatch(rf"COUNT\(\s*(?:DISTINCT\s+)?(\w+)\s*\)\s*{_OP}\s*(.+)", t, re.I):
        return Clause("count_col", m[1], m[2], _value(m[3]))
    if m := re.fullmatch(rf"CELL\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*{_OP}\s*(.+)", t, re.I):
        return Clause("cell", op=m[3], value=_value(m[4]), cell=(int(m[1]), int(m[2])))
    if m := re.fullmatch(r"(\w+)\s+(NOT\s+)?IN\s*\((.*)\)", t, re.I | re.S):
        items = [_value(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s][^,]*", m[3])]
        return Clause("not_in" if m[2] else "in", m[1], value=tuple(items))
    if m := re.fullmatch(rf"(\w+)\s*{_OP}\s*(.+)", t, re.S):
        return Clause("column", m[1], m[2], _value(m[3]))
    raise ValueError(f"no assertion: {text!r}")


def parse(text: str) -> list[tuple[str, Clause]]:
    """Clauses with the word that joins each to those before; read from left to right, AND and OR bind alike."""
    t = html.unescape(text).strip()
    if t.startswith("(") and t.endswith(")") and t.count("(") == 1:
        t = t[1:-1]
    parts = re.split(r"\s+(AND|OR)\s+", t, flags=re.I)
    return [("AND", parse_clause(parts[0])), *[(parts[i].upper(), parse_clause(parts[i + 1])) for i in range(1, len(parts), 2)]]


def bridged(df: DataFrame) -> DataFrame:
    """Rows of mixed content also get ID_MOVIE, ID_SERIE and ID_PERSON, if they lack them."""
    have = {c.upper(): c for c in df.columns}
    if "ID_CONTENT" not in have or "CONTENT_TYPE" not in have:
        return df
    kind = F.lower(F.col(have["CONTENT_TYPE"]))
    return df.select("*", *[F.when(kind == k, F.col(have["ID_CONTENT"])).alias(f"ID_{k.upper()}") for k in ("movie", "serie", "person") if f"ID_{k.upper()}" not in have])


def _same(column: str, value) -> Column:
    return F.col(column).cast("string") == str(value) if isinstance(value, str) else F.col(column).cast("double") == float(value)


def check(df: DataFrame, text: str, order: list[Column] | None = None) -> bool:
    """Whether the rows fulfil the assertion. All clauses but cells are counted in one aggregate over the rows."""
    clauses = parse(text)
    df = bridged(df)
    have = {c.upper(): c for c in df.columns}
    aggs: dict[str, Column] = {"n": F.count("*")}
    for i, (_, c) in enumerate(clauses):
        if c.column and c.column.upper() not in have:
            continue
        col = have.get((c.column or "").upper())
        if c.kind == "count_col":
            aggs[f"c{i}"] = F.countDistinct(col)
        elif c.kind == "in":
            for k, v in enumerate(c.value):
                aggs[f"c{i}_{k}"] = F.count_if(_same(col, v))
        elif c.kind == "not_in":
            aggs[f"c{i}"] = F.count_if(_any(col, c.value))
        elif c.kind == "column":
            left = F.col(col) if isinstance(c.value, str) else F.col(col).cast("double")
            aggs[f"c{i}"] = F.count_if(~F.coalesce(_OPS[c.op](left, F.lit(c.value)), F.lit(c.op in ("!=", "<>"))))
    row = df.agg(*[a.alias(n) for n, a in aggs.items()]).first().asDict()
    if not row["n"]:
        return bool(re.search(r"COUNT\(\s*\*\s*\)", text, re.I) and re.search(r"={1,2}\s*0\b", text))
    out = None
    for i, (word, c) in enumerate(clauses):
        got = False
        if c.kind == "count":
            got = _OPS[c.op](row["n"], c.value)
        elif c.kind == "cell":
            r, k = c.cell
            x = (df.orderBy(*order) if order else df).offset(r).limit(1).collect()
            if x and k < len(df.columns):
                v = x[0][k]
                got = v is not None and _OPS[c.op](str(v) if isinstance(c.value, str) else float(v), c.value)
        elif c.kind == "count_col" and f"c{i}" in row:
            got = _OPS[c.op](row[f"c{i}"], c.value)
        elif c.kind == "in":
            got = bool(c.value) and all(row.get(f"c{i}_{k}", 0) > 0 for k in range(len(c.value)))
        elif f"c{i}" in row:
            got = row[f"c{i}"] == 0
        out = got if out is None else (out and got if word == "AND" else out or got)
    return bool(out)


def _any(column: str, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(_same(column, v), F.lit(False))
    return out


def total_score(*parts: str) -> Column:
    """1 if every score that isn't null is 1, else 0; null if all are null."""
    nn = F.filter(F.array(*[F.col(p).cast("double") for p in parts]), lambda x: x.isNotNull())
    return F.when(F.size(nn) == 0, None).otherwise(F.forall(nn, lambda x: x == 1).cast("int"))


def outcome(passed: str, retried: str, empty: str) -> Column:
    """The label of a run from whether it passed, was tried again, and was empty at first."""
    p, r, e = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (passed, retried, empty))
    return F.when(p & ~r, "direct_success").when(p, "recovered_by_retry").when(r, "retried_but_failed").when(e, "gave_up_empty").otherwise("wrong_result_no_retry")


def sql_text_score(sql: str, pattern: str) -> Column:
    """1 if the SQL text matches the pattern anywhere, 0 if not or if there is no text; null where nothing is asserted."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(pattern), "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    text = F.trim(F.col(sql))
    return F.when(F.coalesce(p, F.lit("")) == "", None).when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_like(text, p).cast("int"))


def efficiency(runs: DataFrame, passed: str, seconds: str, key: list[str], budget: float = 1.0) -> DataFrame:
    """Of each key's passing runs: number, mean, 50th and 95th percentile by nearest rank, share within the budget of all runs, and number of slow ones."""
    ok = F.coalesce(F.col(passed).cast("boolean"), F.lit(False))
    fast = ok & (F.col(seconds) <= budget)
    out = runs.groupBy(*key).agg(F.count_if(ok).alias("n_passed"), F.round(F.avg(F.when(ok, F.col(seconds))), 6).alias("mean"), rate(F.count_if(fast), F.count("*")).alias("correct_and_fast"), F.count_if(ok & (F.col(seconds) > budget)).alias("correct_but_slow"))
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        out = out.join(nearest_rank(runs.where(ok), seconds, p, key).withColumnRenamed("value", name), key, "left")
    return out


def slow_but_correct(runs: DataFrame, passed: str, seconds: str, budget: float = 1.0) -> DataFrame:
    return runs.where(F.coalesce(F.col(passed).cast("boolean"), F.lit(False)) & (F.col(seconds) > budget))


def living_assertion(df: DataFrame, most: int = 50) -> str:
    """``ID_X IN (...)`` from a stored query's rows, in their order: one column whose name starts with ID_, 1 to ``most`` distinct ids."""
    if len(df.columns) != 1 or not df.columns[0].upper().startswith("ID_"):
        raise ValueError("a refresh query has one column, an id")
    ids = list(dict.fromkeys(r[0] for r in df.limit(most + 1).collect() if r[0] is not None))
    if not 1 <= len(ids) <= most:
        raise ValueError(f"a refresh query gives 1 to {most} ids")
    said = ", ".join(str(i) if isinstance(i, int) else "'" + str(i) + "'" for i in ids)
    return f"{df.columns[0].upper()} IN ({said})"


def rate(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def extraction_ok(expression: str, got: dict) -> bool:
    """The extraction language: eq, seteq, nonempty, matches, has, keys joined by and, or, not; parsed, never run as code."""
    import ast

    calls = {
        "eq": lambda k, v: got.get(k) == v, "seteq": lambda k, v: set(got.get(k) or []) == set(v), "nonempty": lambda k: bool(got.get(k)),
        "matches": lambda k, p: re.search(p, str(got.get(k, ""))) is not None, "has": lambda k: k in got, "keys": lambda *k: set(got) == set(k),
    }

    def walk(n):
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.BoolOp):
            return all(map(walk, n.values)) if isinstance(n.op, ast.And) else any(map(walk, n.values))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return not walk(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in calls and not n.keywords:
            return calls[n.func.id](*map(ast.literal_eval, n.args))
        raise ValueError("only eq, seteq, nonempty, matches, has, keys with literals are allowed")

    return bool(walk(ast.parse(expression, mode="eval")))
