"""Saved strategies in a Parquet folder: append, list, get, delete, export."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id long, name string, expression string, notes string, sharpe double, annual_return double, max_drawdown double, turnover double, fitness double, "
    "created_at string, result_json string, code_signature string, data_signature string, git_hash string"
)
SERIES = "struct<dates:array<string>,returns:array<double>>"
RESULT = f"`is` {SERIES}, oos {SERIES}, timeseries {SERIES}"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Store:
    """One folder. New columns may be added to rows later; older rows then have nulls there. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        fs, path, old = self._files(self.path, f"{self.path}.old")
        if not fs.exists(path) and fs.exists(old):  # a deletion was cut off
            fs.rename(old, path)
        return fs.exists(path) and len(fs.listStatus(path)) > 0

    def rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        for column in SCHEMA.split(", "):
            name, kind = column.split()
            if name not in found.columns:
                found = found.withColumn(name, F.lit(None).cast(kind))
        return found

    def save(self, **values) -> int:
        """Appends a row and gives its id; unknown names become new string columns."""
        last = self.rows().agg(F.max("id").alias("id")).first()["id"]
        id_ = (last or 0) + 1
        values = {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **values, "id": id_}
        extra = [n for n in values if n not in COLUMNS]
        schema = SCHEMA + "".join(f", {n} string" for n in extra)
        row = tuple(values.get(n) if n in COLUMNS else str(values[n]) for n in [*COLUMNS, *extra])
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(self.path)
        return id_

    def list(self, min_sharpe: float | None = None, max_drawdown: float | None = None, signed: bool = False, by: str = "newest", limit: int | None = None) -> DataFrame:
        """Rows with at least min_sharpe, no deeper drawdown than max_drawdown (a negative number), signatures if signed; by `newest` or `sharpe`."""
        rows = self.rows()
        if min_sharpe is not None:
            rows = rows.where(F.col("sharpe") >= min_sharpe)
        if max_drawdown is not None:
            rows = rows.where(F.col("max_drawdown") >= max_drawdown)
        if signed:
            rows = rows.where("code_signature is not null and data_signature is not null")
        rows = rows.orderBy(F.desc("id")) if by == "newest" else rows.orderBy(F.desc_nulls_last("sharpe"), F.desc("id"))
        return rows if limit is None else rows.limit(limit)

    def get(self, id_: int) -> dict | None:
        row = self.rows().where(F.col("id") == id_).first()
        return row.asDict() if row else None

    def delete(self, id_: int) -> bool:
        """Writes the other rows beside the old ones, puts the old ones aside, the new ones in their place, and drops the old ones last.

        Whatever step is the last one done, the rows are in the folder or, between the two renames, in `.old`: rows() puts them back.
        """
        if self.get(id_) is None:
            return False
        new, old = f"{self.path}.new", f"{self.path}.old"
        self.rows().where(F.col("id") != id_).write.mode("overwrite").parquet(new)
        fs, path, new, old = self._files(self.path, new, old)
        fs.delete(old, True)
        if not fs.rename(path, old) or not fs.rename(new, path):
            return False
        fs.delete(old, True)
        return True

    def _files(self, *names: str) -> list:
        """The file system and paths of names."""
        paths = [self.spark._jvm.org.apache.hadoop.fs.Path(n) for n in names]
        return [paths[0].getFileSystem(self.spark._jsc.hadoopConfiguration()), *paths]

    def returns(self) -> DataFrame:
        """(id, date, ret) of the daily series in result_json: both halves one after another, or the single older series."""
        parsed = self.rows().select("id", F.from_json("result_json", RESULT).alias("r"))
        part = lambda p: F.arrays_zip(F.coalesce(f"r.{p}.dates", F.array().cast("array<string>")), F.coalesce(f"r.{p}.returns", F.array().cast("array<double>")))
        halves = F.concat(part("is"), part("oos"))
        points = F.when(F.size(halves) > 0, halves).otherwise(part("timeseries"))
        return parsed.select("id", F.explode(points).alias("p")).select("id", F.to_date(F.col("p")["0"]).alias("date"), F.col("p")["1"].alias("ret")).where("ret is not null")

    def export(self, id_: int, kind: str = "text") -> str:
        """One row as text with a header of its origin, or as JSON."""
        row = self.get(id_)
        if row is None:
            raise KeyError(f"no strategy {id_}")
        if kind == "json":
            return json.dumps({k: v for k, v in row.items() if k != "result_json"} | {"settings": json.loads(row["result_json"] or "{}").get("settings")}, indent=2, sort_keys=True)
        head = [f"# {row['name']} (id {row['id']}, saved {row['created_at']})", *[f"# {k}: {row[k]}" for k in ("sharpe", "annual_return", "max_drawdown", "turnover", "code_signature", "data_signature", "git_hash", "notes") if row[k] is not None]]
        return "\n".join([*head, row["expression"], ""])


def result_json(daily_rows: list[dict], settings: dict) -> str:
    """The JSON that Store.returns() reads, from rows (segment, date, ret)."""
    out: dict = {"settings": settings}
    for half in ("is", "oos"):
        rows = sorted((str(r["date"]), r["ret"]) for r in daily_rows if r["segment"] == half)
        if rows:
            out[half] = {"dates": [d for d, _ in rows], "returns": [v for _, v in rows]}
    return json.dumps(out)
