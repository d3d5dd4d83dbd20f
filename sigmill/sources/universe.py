"""Universes: named lists of tickers, their labels, and who belonged to them when."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import LABEL_COLUMNS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, sector, industry_group, industry, sub_industry) of a JSON-lines file; absent labels are null."""
    raw = spark.read.schema("ticker string, " + ", ".join(f"{c} string" for c in LABEL_COLUMNS)).json(path)
    return raw.where("ticker is not null").dropDuplicates(["ticker"])


def merged_labels(*tables: DataFrame) -> DataFrame:
    """Labels of all tables (ticker, some label columns): for each label the first table that has one for the ticker."""
    names = [c for c in LABEL_COLUMNS if any(c in t.columns for t in tables)]
    rows = None
    for k, t in enumerate(tables):
        part = t.select("ticker", F.lit(k).alias("_k"), *[(F.col(c) if c in t.columns else F.lit(None).cast("string")).alias(c) for c in names])
        rows = part if rows is None else rows.unionByName(part)
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_k")))
    return rows.groupBy("ticker").agg(*[pick(c).alias(c) for c in names])


def read_universes(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """name -> tickers in their order, of a Parquet table (universe, ticker, ord). Universes are lists that people wrote: a few thousand rows."""
    rows = spark.read.parquet(path).orderBy("universe", "ord", "ticker").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["universe"], []).append(r["ticker"])
    return {name: tuple(dict.fromkeys(tickers)) for name, tickers in out.items()}


class Catalogue:
    """Named universes (name -> tickers), the first of them the default."""

    def __init__(self, universes: dict[str, tuple[str, ...]]):
        self.universes = {name: tuple(dict.fromkeys(tickers)) for name, tickers in universes.items()}

    def list(self) -> list[dict]:
        """Name and number of tickers of each."""
        return [{"name": name, "n_tickers": len(tickers)} for name, tickers in self.universes.items()]

    def get(self, name: str | None = None) -> tuple[str, ...]:
        """The tickers of a universe, without a name of the default one."""
        if name is None and self.universes:
            return next(iter(self.universes.values()))
        if name not in self.universes:
            raise KeyError(f"unknown universe {name!r}: {', '.join(self.universes) or 'there are none'}")
        return self.universes[name]

    def union(self, *names: str) -> tuple[str, ...]:
        """The tickers of the named universes, or of all, each once, in the order of their first place."""
        return tuple(dict.fromkeys(t for name in names or self.universes for t in self.get(name)))

    def labels(self, name: str | None, labels: DataFrame) -> DataFrame:
        """The rows of labels (ticker, ...) of a universe's tickers."""
        spark = labels.sparkSession
        wanted = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(self.get(name))), "array<string>")).alias("ticker"))
        return labels.join(F.broadcast(wanted), "ticker", "left_semi")  # a list that people wrote


def members(panel: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(date, ticker, is_member): whether each ticker belongs on each date; those without a join_date always do."""
    late = inclusion.select("ticker", "join_date")
    joined = panel.select("date", "ticker").join(late, "ticker", "left")
    return joined.select("date", "ticker", (F.col("join_date").isNull() | (F.col("date") >= F.col("join_date"))).alias("is_member"))


def membership(panel: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(date, n_members, n_late) per date: how many tickers belong, and how many don't yet."""
    flag = F.col("is_member").cast("int")
    return members(panel, inclusion).groupBy("date").agg(F.sum(flag).alias("n_members"), F.sum(1 - flag).alias("n_late"))


def missing(wanted: DataFrame, panel: DataFrame) -> DataFrame:
    """(ticker): wanted tickers that the panel doesn't have."""
    return wanted.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().join(panel.select("ticker").distinct(), "ticker", "left_anti")
