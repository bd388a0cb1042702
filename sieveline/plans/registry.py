"""Registered queries: each is a Spark job over the given tables, most with an SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans import inputs as I
from sieveline.session import balanced, checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def work(self, name: str) -> str:
        """A fresh folder under the session's shared checkpoint folder."""
        return f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    @cached_property
    def documents(self) -> DataFrame:
        return balanced(self.read("documents").select("doc_id", "lang", "source", "text"), "doc_id")

    @cached_property
    def probed(self) -> DataFrame:
        """Every document with a passage of personal data, a secret or code behind its text, chosen by its id."""
        return self.documents.withColumn("text", F.expr(f"text || {I.PROBE}"))

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)


def query(sql: str | None = None):
    """Register the decorated ``Tables -> DataFrame`` function under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
