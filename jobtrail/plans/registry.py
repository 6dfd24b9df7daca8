"""Named reports over the driver's tables: each pairs a DataFrame with the SQL that checks it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def flat(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds and integers as bigint, so that both engines print the same."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def report(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a report. ``sql`` runs after the named view definitions of ``views_sql``."""

    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: flat(build(Views(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = with_views(sql, ctes, recursive)
        return build

    return add


def with_views(sql: str, ctes: tuple[str, ...], recursive: bool = False) -> str:
    from jobtrail.plans.views_sql import VIEWS

    ordered: list[str] = []

    def need(view: str):
        needs, _ = VIEWS[view]
        for other in needs:
            need(other)
        if view not in ordered:
            ordered.append(view)

    for view in ctes:
        need(view)
    parts = [f"{view} AS ({VIEWS[view][1]})" for view in ordered]
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return head + ", ".join([*parts, body]) if parts else head + body
    return head + ", ".join(parts) + " " + body if parts else body
