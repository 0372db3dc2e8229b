"""The registry of jobs: a small YAML file, read on the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("job_id", "label", "spec_file", "prompt_template", "output_schema", "output_dir")


def load_registry(spark: SparkSession, path: str, base: str | None = None, check_files: bool = True) -> DataFrame:
    """(job_id, label, four paths) of each job; of repeated ids the last counts. Bad entries are errors."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    text = lambda d, k: d[k] if isinstance(d.get(k), str) and d[k].strip() else _bad(f"{k!r} is missing or blank")
    text(data, "version"), text(data, "project")
    jobs = data.get("jobs")
    if not isinstance(jobs, list) or not jobs:
        _bad("'jobs' must be a list that isn't empty")
    found, root = {}, base or os.path.dirname(os.path.abspath(path))
    for job in jobs:
        if not isinstance(job, dict):
            _bad("a job must be a mapping")
        row = [text(job, k) for k in FIELDS]
        row[2:] = [os.path.join(root, p) for p in row[2:]]
        for p in row[2:5] if check_files else ():
            if not os.path.exists(p):
                raise FileNotFoundError(f"job {row[0]!r}: {p}")
        found[row[0]] = tuple(row)
    return spark.createDataFrame(list(found.values()), ", ".join(f"{k} string" for k in FIELDS))


def job(registry: DataFrame, job_id: str):
    row = registry.where(registry.job_id == job_id).first()
    if row is None:
        raise KeyError(f"unknown job {job_id!r}")
    return row


def _bad(what: str):
    raise ValueError(f"registry: {what}")
