"""Registration of queries: a result schema holds for the Spark query and for its DuckDB equivalent alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctes import CTES

TYPES = {"l": ("long", "BIGINT"), "s": ("string", "VARCHAR"), "d": ("double", "DOUBLE"), "b": ("boolean", "BOOLEAN")}


class Queries:
    """The queries of one module. A schema is text such as ``score_id:l step:s``."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, schema: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        columns = [c.split(":") for c in schema.split()]

        def typed(spark: SparkSession, folder: str) -> DataFrame:
            df = query(spark, folder)
            return df.select(*[F.col(c).cast(TYPES[t][0]).alias(c) for c, t in columns])

        self.queries[name] = typed
        if sql:
            self.oracles[name] = f"{with_ctes(sql)}\nSELECT {', '.join(f'CAST("{c}" AS {TYPES[t][1]}) AS "{c}"' for c, t in columns)} FROM result"


def with_ctes(sql: str) -> str:
    """The query as the CTE ``result``, after the CTEs that it names, and those that they name."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    return "WITH RECURSIVE " + ",\n".join([f"{n} AS ({CTES[n]})" for n in needed] + [f"result AS ({sql})"])
