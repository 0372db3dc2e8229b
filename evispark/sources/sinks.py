"""Results to files."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(outputs: DataFrame, path: str) -> None:
    """One JSON text per line, whether valid or not: validity is a table of its own (see ``validation.violations``)."""
    outputs.select("json").write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str, model: str) -> None:
    index.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def write_index_json(index: DataFrame, path: str, model: str) -> None:
    """An index as one JSON text, for exchange: it has to fit in a row."""
    place = [c for c in ("source_id", "pos", "part") if c in index.columns]
    entry = F.struct("source_id", "source_title", "locator", "text", "type", "embedding")
    listed = index.agg(F.array_sort(F.collect_list(F.struct(*place, entry.alias("v")))).alias("s"))
    one = F.struct(F.lit(model).alias("model"), F.size("s").alias("snippet_count"), F.transform("s", lambda x: x["v"]).alias("snippets"))
    write_json(listed.select(F.to_json(one).alias("json")), path)


def write_sources_json(sources: DataFrame, path: str) -> None:
    """Scanned sources with their snippets as one JSON text, for exchange; sources without any stay, with none."""
    snippet = F.when(F.col("text").isNotNull(), F.struct("pos", "part", F.struct("locator", "text", "type").alias("v")))
    kind = F.upper("source_type")
    by = sources.groupBy("source_id", "source_title", "source_type", F.col("path").alias("file_path"), F.concat("source_title", F.lit(" ("), kind, F.lit(" document)")).alias("reference"))
    rows = by.agg(F.transform(F.array_sort(F.collect_list(snippet)), lambda x: x["v"]).alias("snippets"))
    number = F.regexp_extract("source_id", "[0-9]+", 0).try_cast("int")
    one = rows.agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.struct(*rows.columns).alias("v")))).alias("s"))
    write_json(one.select(F.to_json(F.struct(F.transform("s", lambda x: x["v"]).alias("sources"))).alias("json")), path)


def index_name(sources: str) -> str:
    """``x_sources.json`` -> ``x_index``."""
    stem = re.sub(r"\.[^./]+$", "", sources)
    return f"{stem.removesuffix('_sources')}_index"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """Small tables as the sheets of a workbook; columns as wide as their longest value, within limits."""
    from ..operators.rendering import column_widths
    from .office import xlsx

    sheets = {n: (t.columns, [tuple(r) for r in t.collect()]) for n, t in tables.items()}
    widths = {n: [r["width"] for r in column_widths(t, t.columns).collect()] for n, t in tables.items()}
    with open(path, "wb") as f:
        f.write(xlsx(sheets, widths))


def write_docx(title: str, rows: DataFrame, path: str) -> None:
    """Narrative rows (pos, heading, body, quality, rationale, citations) as a document."""
    from .office import docx

    blocks = [("Title", title)]
    for r in rows.orderBy("pos").collect():
        blocks += [("Heading1", r["heading"] or ""), ("Normal", r["body"] or ""), ("Normal", f"Evidence quality: {r['quality'] or ''}"), ("Normal", f"Rationale: {r['rationale'] or ''}")]
        blocks += [("Normal", r["citations"])] if r["citations"] else []
    with open(path, "wb") as f:
        f.write(docx(blocks))


def run_folder(base: str, job_id: str, country: str | None = None, now: datetime | None = None) -> str:
    """``{base}/{job}/{country}_YYYYMMDD_HHMMSS``; a base that ends in a time already is used as it is."""
    if re.search(r"_\d{8}_\d{6}/?$", base):
        return base.rstrip("/")
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return f"{base.rstrip('/')}/{job_id}/{(country or 'run').lower()}_{stamp}"


def status_summary(statuses: DataFrame) -> DataFrame:
    """Counts by status, and whether the batch failed: anything but SUCCESS does, SKIP included."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("failed", F.col("status") != "SUCCESS")
