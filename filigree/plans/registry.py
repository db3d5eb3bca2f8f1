"""How queries are registered: a function over the given tables and fixtures, with its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES, SPARK_ONLY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables, and the fixtures that are derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Few ids make many cells: adaptive execution would merge the ids, being small, to one task, or broadcast them to the
        # task of the 48 lines. So they are dealt out, and lines and columns are broadcast.
        dealt = f"(SELECT /*+ REPARTITION({self.spark.conf.get('spark.sql.shuffle.partitions')}) */ DISTINCT"
        text = SPARK_ONLY.get(name, FIXTURES[name]).replace("(SELECT DISTINCT l_suppkey", f"{dealt} l_suppkey").replace("SELECT i.image_id", "SELECT /*+ BROADCAST(r, c) */ i.image_id")
        return self.spark.sql(text, **{k: getattr(self, k) for k in set(re.findall(r"\{(\w+)\}", text))})


def twin(sql: str) -> str:
    """The DuckDB text with all fixtures that it names as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(FIXTURES[name])
                needed.append(name)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS ({plain(FIXTURES[n])})" for n in needed)
    if not head:
        return sql
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\b", sql, re.I)
    if own:
        return f"WITH{own[1] or ''} {head}, {sql[own.end():]}"
    return f"WITH {head} {sql}"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name; ``sql`` gives the same rows in DuckDB."""

    def register(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = twin(sql)
        return f

    return register
