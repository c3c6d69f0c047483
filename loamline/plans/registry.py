"""A registered query pairs a Spark function with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loamline.plans.views import Tables, oracle_with


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Registered] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """``uses`` lists the views the SQL text refers to; the text may start with its own CTE list."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"Query registered twice: {name}")
        text = None
        if sql is not None:
            head = oracle_with(tuple(uses.split()))
            body = sql.strip()
            if head and body[:15].lower() == "with recursive ":
                text = f"with recursive {head},\n{body[15:]}"
            elif head and body[:5].lower() == "with ":
                text = f"with {head},\n{body[5:]}"
            elif head:
                text = f"with {head}\n{body}"
            else:
                text = body
        REGISTRY[name] = Registered(name, build, text)
        return build

    return register
