"""Whole jobs: scan, index, run, merge, validate, render."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import chunking, merging, rendering, selection, stubs, validation
from ..sources import file_sink, files, sinks
from . import generation, prompts
from .schema import Gate


def scan_sources(spark: SparkSession, folder: str, readers=None, max_chars: int = chunking.MAX_CHARS) -> DataFrame:
    """(source_id, source_title, source_type, path, pos, part, locator, text, type) of a folder's documents."""
    found = files.scan_directory(spark, folder)
    snippets = chunking.chunk_snippets(files.snippets_of(files.read_blocks(found, readers)), max_chars)
    named = found.select("path", "source_id", F.regexp_replace("name", r"\.[^.]+$", "").alias("source_title"), F.col("kind").alias("source_type"))
    return named.join(snippets, "path", "left")


def run_stub(specs: DataFrame, job_id: str, out: str, generated_at: str, **country: str) -> DataFrame:
    made = stubs.stub_outputs(specs, job_id, generated_at, **country)
    sinks.write_json(made, out)
    return made


def render_files(outputs: DataFrame, job_id: str, out: str, form: str = "md") -> None:
    """Many outputs (path, json) as a file each, named like theirs, made and written by the tasks."""
    named = outputs.withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    file_sink.write_files(rendering.files(named, job_id, form), out)


def render(outputs: DataFrame, job_id: str, out: str, form: str = "md") -> None:
    """Markdown text, the flat tables as CSV folders or a workbook, or the narrative as a document."""
    if form == "md":
        sinks.write_text(rendering.markdown(outputs, job_id), "markdown", out)
    elif form == "csv":
        for name, table in rendering.flat_tables(outputs, job_id).items():
            sinks.write_csv(table, f"{out}/{name}")
    elif form == "xlsx":
        sinks.write_xlsx(rendering.flat_tables(outputs, job_id), out)
    else:
        sinks.write_docx(job_id, rendering.narrative_rows(outputs, job_id), out)


def index_sources(sources: DataFrame, embedder: Callable[[list[str]], list[list[float]]], out: str, model: str, form: str = "parquet") -> None:
    """Snippets of scanned sources with their vectors and lengths, as Parquet (or their JSON form). An error if there is no text."""
    rows = sources.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if not rows.take(1):
        raise ValueError("no snippet has text")
    made = generation.embed(rows, embedder).withColumn("norm", norm(F.col("embedding")))
    (sinks.write_index_json if form == "json" else sinks.write_index)(made, out, model)


def merge_outputs(outputs: DataFrame, job_id: str, batch: str = "batch") -> DataFrame:
    """(json): partial outputs (batch, json) of one job as one. A single one comes back unchanged; none is an error."""
    config = merging.merge_config(job_id)
    n = outputs.limit(2).count()
    if n == 0:
        raise ValueError("no partial outputs to merge")
    if n == 1:
        return outputs.select("json")
    rows = outputs.select(F.col(batch).alias("batch"), rendering.parse_output(F.col("json"), job_id).alias("p"))
    items = rows.select("batch", F.posexplode(f"p.{config.array_key}").alias("pos", "x")).select("batch", "pos", "x.*")
    arrays = tuple(c for c in merging.ARRAY_FIELDS if c in items.columns)
    merged = merging.merge_items(items, config.id_key, config.text_keys, arrays, "evidence" if "evidence" in items.columns else None)
    fields = [c for c in items.columns if c not in ("batch", "pos")]
    listed = merged.agg(F.sort_array(F.collect_list(F.struct("item_order", F.struct(*fields).alias("v")))).alias("xs"))  # one output
    head = rows.agg(F.min_by("p", "batch").alias("p"))
    top = [F.col(f"p.{c}") for c in ("job_id", "spec_id", "generated_at", "country")]
    return head.crossJoin(listed).select(F.to_json(F.struct(*top, F.transform("xs", lambda x: x["v"]).alias(config.array_key))).alias("json"))


def clean_outputs(outputs: DataFrame, job_id: str) -> DataFrame:
    """Outputs (…, json) with the citations of their items cleaned."""
    config = merging.merge_config(job_id)
    p = rendering.parse_output(F.col("json"), job_id)

    def cleaned(e):
        return e.withField("citations", validation.clean_citations(e["citations"]))

    def item(x):
        if job_id != "benchmark_country_scoring":
            return x.withField("evidence", cleaned(x["evidence"]))
        scored = lambda s: s.withField("evidence", cleaned(s["evidence"]))
        dims = F.transform(x["dimensions"], lambda d: d.withField("score_note", scored(d["score_note"])))
        return x.withField("overall_score", scored(x["overall_score"])).withField("dimensions", dims)

    return outputs.withColumn("json", F.to_json(p.withField(config.array_key, F.transform(p[config.array_key], item))))


def run_rag(
    specs: DataFrame, job_id: str, index: DataFrame, template: str, provider: Callable[[str], str], embedder: Callable[[list[str]], list[list[float]]], k: int = 40,
    asking: generation.Asking | None = None,
) -> DataFrame:
    """(json): per item its best snippets, a prompt and an answer; answers cleaned and merged in item order."""
    queries = generation.embed(prompts.rag_queries(specs, job_id), embedder, "query")
    queries = queries.select(F.col("pos").alias("query_id"), F.col("embedding").alias("query"), F.struct(F.col("query").alias("item")).alias("inputs"))
    answers = generation.generate_all(prompts.rag_prompts(queries, index, template, k), provider, "query_id", asking=asking)
    return merge_outputs(clean_outputs(answers.select(F.col("query_id").cast("int").alias("batch"), "json"), job_id), job_id)


def run_batches(
    specs: DataFrame, job_id: str, sources: DataFrame, template: str, provider: Callable[[str], str], split: bool = True,
    max_snippet_chars: int = selection.BUDGET, gate: Gate | None = None, asking: generation.Asking | None = None, **country: str,
) -> DataFrame:
    """(json): one prompt per source with snippets (each with all sources without), or one for all; answers repaired, then merged in the sources' order."""
    full = sources.where(F.size("snippets") > 0)
    if not split or full.limit(2).count() < 2:
        made = prompts.job_prompt(specs, template, job_id, sources=sources, max_snippet_chars=max_snippet_chars, **country)
        return generation.generate_all(made, provider, "spec_id", gate, asking=asking).select("json")
    dealt = selection.source_batches(sources)
    asked = prompts.job_prompt(specs, template, job_id, sources=dealt, max_snippet_chars=max_snippet_chars, batch="batch", **country)
    answers = generation.generate_all(asked, provider, "batch", gate, asking=asking)
    places = full.select(F.col("source_id").alias("batch"), "pos")
    return merge_outputs(answers.join(places, "batch").select(F.struct("pos", "batch").alias("batch"), "json"), job_id)
