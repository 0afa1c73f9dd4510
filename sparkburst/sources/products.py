"""Products of burst voltages: which files a range of days or a table needs, which are there, and their transfer.

Plans are frames (kind, day, hour, name). Transfers run in tasks, a file each, and give a
status per row; counts are aggregates of it.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime
from urllib.error import URLError
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

#: Hours at which products start; fixed values.
HOURS = ("00", "06", "12", "18")


def as_date(value: str | date | datetime) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else datetime.strptime(value, "%Y-%m-%d").date()


def date_range(spark: SparkSession, start: str | date, end: str | date) -> DataFrame:
    """Days from start to end, both included; none if end comes first."""
    first, last = as_date(start), as_date(end)
    days = spark.range(max((last - first).days + 1, 0))
    return days.select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))


def file_name(kind: Column, day: Column, hour: Column) -> Column:
    return F.format_string("%s_%s%s.cdf", kind, F.date_format(day, "yyyyMMdd"), hour)


def download_plan(spark: SparkSession, kind: str, *, day=None, hour: str | None = None, all_hours: bool = False, start=None, end=None) -> DataFrame:
    """(kind, day, hour, name): a range of days with all hours, or one day with all hours or one of HOURS.

    A range with one end missing counts only if there is no day to fall back on, and is refused then.
    """
    if start is not None and end is not None:
        days, hours = date_range(spark, start, end), HOURS
    elif day is None and (start is not None or end is not None):
        raise ValueError("a range needs its start and its end")
    elif day is None:
        raise ValueError("a day or a range is needed")
    elif all_hours:
        days, hours = date_range(spark, day, day), HOURS
    elif hour not in HOURS:
        raise ValueError(f"hour must be one of {HOURS}")
    else:
        days, hours = date_range(spark, day, day), (hour,)
    plan = days.select(F.lit(kind).alias("kind"), "day", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour"))
    return plan.withColumn("name", file_name(F.col("kind"), F.col("day"), F.col("hour")))


def plan_of_times(rows: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """The plan that holds the times of a table: per time the product of its day that starts last before it; rows without a time need none."""
    starts = F.array(*[F.lit(h) for h in HOURS])
    at = F.element_at(F.filter(starts, lambda h: h.cast("int") <= F.hour(ts)), -1)
    plan = rows.where(F.col(ts).isNotNull()).select(F.lit(kind).alias("kind"), F.to_date(ts).alias("day"), at.alias("hour")).distinct()
    return plan.withColumn("name", file_name(F.col("kind"), F.col("day"), F.col("hour")))


def range_of_times(rows: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """The plan of all products from a table's first day to its last; none for a table without times."""
    span = rows.agg(F.min(ts).alias("first"), F.max(ts).alias("last")).where("first is not null")
    days = span.select(F.explode(F.sequence(F.to_date("first"), F.to_date("last"))).alias("day"))
    plan = days.select(F.lit(kind).alias("kind"), "day", F.explode(F.array(*[F.lit(h) for h in HOURS])).alias("hour"))
    return plan.withColumn("name", file_name(F.col("kind"), F.col("day"), F.col("hour")))


def with_address(plan: DataFrame, template: str) -> DataFrame:
    """Add ``url``: the template with {kind}, {year}, {month}, {day}, {hour} and {name} filled in; other text stays."""
    parts = {"kind": F.col("kind"), "hour": F.col("hour"), "name": F.col("name"), "year": F.date_format("day", "yyyy"), "month": F.date_format("day", "MM"), "day": F.date_format("day", "dd")}
    url = F.lit(template)
    for key, value in parts.items():
        url = F.replace(url, F.lit(f"{{{key}}}"), value)
    return plan.withColumn("url", url)


def present_products(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder; their contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def missing_products(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Products of the plan that aren't among the present names."""
    return plan.join(present, "name", "left_anti")


def fetch(url: str, path: str) -> bool:
    """Bring one file to its name once it is whole; False if the server refuses it or can't be reached."""
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        with urlopen(url) as source, open(part, "xb") as target:
            shutil.copyfileobj(source, target)
        os.replace(part, path)
    except URLError:
        return False
    finally:
        if os.path.exists(part):
            os.remove(part)
    return True


def transfer(plan: DataFrame, template: str, folder: str, fetcher: Callable[[str, str], bool] = fetch, tasks: int = 8) -> DataFrame:
    """(name, url, path, status): bring a plan's products to a folder that all executors share.

    ``status`` is skipped (there before), downloaded or failed; ``path`` is null for failed
    ones. Absent files are dealt over tasks; the result is stored, so nothing is fetched twice
    however often it is read. A task that is repeated finds its whole files and keeps them.
    """
    spark = plan.sparkSession
    os.makedirs(folder, exist_ok=True)
    present = stored(present_products(spark, folder))
    wanted = with_address(plan.dropDuplicates(["name"]), template).select("name", "url")

    def bring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [os.path.exists(os.path.join(folder, n)) or fetcher(u, os.path.join(folder, n)) for n, u in zip(f["name"], f["url"])]
            yield f.assign(status=["downloaded" if d else "failed" for d in done])

    brought = missing_products(wanted, present).repartition(tasks, "name").mapInPandas(bring, "name string, url string, status string")
    kept = wanted.join(present, "name", "left_semi").withColumn("status", F.lit("skipped"))
    path = F.when(F.col("status") != "failed", F.concat(F.lit(folder.rstrip("/") + "/"), "name"))
    return stored(brought.unionByName(kept).select("name", "url", path.alias("path"), "status"))


def transfer_counts(statuses: DataFrame) -> DataFrame:
    """(skipped, downloaded, failed): one row of counts, zeros for an empty plan."""
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("skipped", "downloaded", "failed")])
