"""Runs over many countries: a catalogue of what every run made, how long it took and what was wrong with it.

The catalogue is a table partitioned by job, country and run. Each run is committed as it ends, so a batch that is ended
keeps what it has; the latest runs are found in the partitions' names and read alone. Metrics are observed while a run
is written, not counted afterwards.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import lookup_with_fallback
from ..sources.files import is_country_folder
from .schema import Gate, with_problems

KEYS = ("job_id", "country_iso3", "run")
SCHEMA = "json string, problems array<string>, status string, message string, seconds double, job_id string, country_iso3 string, run string"


def country_folders(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """(country_iso3, country_name) of the three-letter subfolders of ``folder`` that hold files, in order.

    ``names`` (country_iso3, country_name) may name them; a country that it doesn't name goes by its letters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    below = F.substring_index(F.col("path"), folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    found = files.select(F.split(below, "/")[0].alias("country_iso3"), F.size(F.split(below, "/")).alias("n"))
    found = found.where((F.col("n") > 1) & is_country_folder(F.col("country_iso3"))).select("country_iso3").distinct()
    if names is None:
        return found.withColumn("country_name", F.col("country_iso3")).orderBy("country_iso3")
    known = names.withColumn("country_iso3", F.upper("country_iso3"))
    return lookup_with_fallback(found.withColumn("__upper", F.upper("country_iso3")), known, "__upper", "country_iso3", "country_name", "country_name").drop("__upper").orderBy("country_iso3")


def record(outputs: DataFrame, gate: Gate, catalogue: str, job_id: str, country_iso3: str, run: str, started: float) -> dict:
    """Adds outputs (json) to the catalogue with what is wrong with them; the run's metrics: outputs, problems, seconds."""
    seen = Observation(f"{job_id} {country_iso3}")
    judged = with_problems(outputs.select("json"), gate)
    judged = judged.observe(seen, F.count(F.lit(1)).alias("outputs"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems"))
    status = F.when(F.size("problems") > 0, "FAILED").otherwise("SUCCESS")
    rows = judged.withColumns({"status": status, "message": F.get("problems", F.lit(0)), "seconds": F.lit(time.time() - started), "job_id": F.lit(job_id), "country_iso3": F.lit(country_iso3), "run": F.lit(run)})
    rows.write.partitionBy(*KEYS).mode("append").parquet(catalogue)
    return seen.get | {"seconds": time.time() - started}


def record_error(spark: SparkSession, error: Exception, catalogue: str, job_id: str, country_iso3: str, run: str, started: float) -> None:
    """Adds a run that made nothing."""
    row = (None, [], "FAILED", f"{type(error).__name__}: {error}", time.time() - started, job_id, country_iso3, run)
    spark.createDataFrame([row], SCHEMA).write.partitionBy(*KEYS).mode("append").parquet(catalogue)


def read_catalogue(spark: SparkSession, catalogue: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(catalogue)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The rows of the latest run of each job and country; ``run`` sorts by time.

    Runs are looked up by their keys alone, which are partitions of the catalogue: only the latest are read.
    """
    newest = runs.groupBy("job_id", "country_iso3").agg(F.max("run").alias("run"))
    return runs.join(newest, list(KEYS), "left_semi")


def summary(runs: DataFrame) -> DataFrame:
    """Per country: jobs, those that failed, seconds of all, and whether it succeeded: no job failed.

    A run with several outputs fails if one does; its seconds count once. Combined before the shuffle.
    """
    each = runs.groupBy(*KEYS).agg(F.max((F.col("status") != "SUCCESS").cast("int")).alias("failed"), F.max("seconds").alias("seconds"))
    by = each.groupBy("country_iso3").agg(F.count(F.lit(1)).alias("jobs"), F.sum("failed").alias("failed"), F.sum("seconds").alias("seconds"))
    return by.withColumn("success", F.col("failed") == 0)


def run_countries(
    spark: SparkSession, countries: DataFrame, job_ids: list[str], prepare: Callable[[str], str], make: Callable[[str, dict, str], DataFrame], gate: Callable[[str], Gate],
    catalogue: str, finish: Callable[[str, str, DataFrame], None] | None = None, now: datetime | None = None,
) -> Iterator[tuple[str, str, str]]:
    """Runs all jobs of all countries, one after another; (country, job, status) as each ends. What fails stops nothing else.

    ``prepare``: makes a country's sources and says where; if it fails, so do the country's jobs. ``make``: (job,
    country's names, sources) to outputs (json). ``finish``: what is done with outputs that are right, rendering for one.
    """
    run = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    for country in countries.collect():  # folders: a few
        iso3 = country["country_iso3"]
        started, sources, broken = time.time(), None, None
        try:
            sources = prepare(iso3)
        except Exception as e:
            broken = e
        for job_id in job_ids:
            try:
                if broken:
                    raise broken
                made = make(job_id, country.asDict(), sources)
                found = record(made, gate(job_id), catalogue, job_id, iso3, run, started)
                if not found["problems"] and finish:
                    finish(job_id, iso3, made)
                status = "FAILED" if found["problems"] or not found["outputs"] else "SUCCESS"
            except Exception as e:
                record_error(spark, e, catalogue, job_id, iso3, run, started)
                status = "FAILED"
            yield iso3, job_id, status
            started = time.time()
