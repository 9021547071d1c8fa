"""SQL texts against registered tables: guard, bind, rewrite, run a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.operators.questions import bind, unresolved
from starloom.operators.relational import Page, merged_limit
from starloom.plans.dialect import rewrite, split_limit


class Ambiguous(ValueError):
    """Placeholders are left, so the text isn't run."""


def run(spark: SparkSession, template: str, bindings: dict | None = None, page: Page | None = None, compat: bool = False) -> DataFrame:
    """One page of a SELECT, or all its rows; a LIMIT of its own stays in force. Values are bound, never written into the text."""
    sql, args = bind(template, bindings or {})
    if left := unresolved(sql):
        raise Ambiguous(", ".join(left))
    if page is None:
        return spark.sql(rewrite(sql), args=args)
    own = split_limit(sql)
    limit, offset = merged_limit(page, own.limit, own.offset, compat)
    return spark.sql(rewrite(own.sql), args=args).offset(offset).limit(limit)
