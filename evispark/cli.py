"""Command line: ``python -m evispark.cli COMMAND …``. Exit codes: 2 usage or input, 3 invalid output, 1 a batch with failures."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import date

from pyspark.sql import functions as F

from .operators import comparator, validation
from .plans import countries, generation, jobs, prompts, schema
from .session import get_session
from .sources import files, registry, sinks


def _specs(spark, path):
    return files.read_json_strict(spark, path).select(F.coalesce(F.get_json_object("json", "$.spec_id"), F.lit("")).alias("spec_id"), "json")


def _invalid(outputs, job_id):
    head = {f"$.{k}: required": F.get_json_object("json", f"$.{k}").isNotNull() for k in ("job_id", "spec_id", "generated_at")}
    head["$.job_id: const"] = F.get_json_object("json", "$.job_id") == job_id
    head["$.generated_at: pattern"] = validation.pattern(F.get_json_object("json", "$.generated_at"), r"^\d{4}-\d{2}-\d{2}$")
    return validation.violations(outputs, head, [])


def _callable(name):
    """``module:function``: a provider of texts or vectors."""
    module, _, function = (name or "").partition(":")
    if not function:
        raise ValueError("give a provider as module:function")
    return getattr(importlib.import_module(module), function)


def _gate(a, j):
    """The job's schema and the rules on citations that the options ask for."""
    allowed = frozenset(x.strip() for x in (a.allowed_sources or "").split(",") if x.strip())
    return schema.Gate(schema.load(j.output_schema) if j else None, a.strict_citations, allowed)


def _wrong(outputs, job_id, gate):
    """What is wrong with outputs, each problem a line."""
    head = [r["path"] for r in _invalid(outputs, job_id).collect()]
    return head + [r["error"] for r in schema.output_errors(outputs, gate).collect()]


def _generated(spark, a, j, who):
    gate = _gate(a, j)
    template = files.read_templates(spark, j.prompt_template).first()["template"]
    specs = _specs(spark, j.spec_file)
    asking = generation.Asking(a.pause, a.store)
    if a.index:
        index = files.read_index_json(spark, a.index) if a.index.endswith(".json") else spark.read.parquet(a.index)
        return jobs.run_rag(specs, j.job_id, index, template, _callable(a.provider), _callable(a.embedder), a.topk, asking)
    if a.sources.endswith(".json"):
        sources = files.read_sources_json(spark, a.sources).select("source_id", "source_title", "snippets", "pos")
    else:
        snippets = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "part", "locator", "text", "type"))))
        sources = spark.read.parquet(a.sources).groupBy("source_id", "source_title").agg(snippets.alias("snippets"))
        sources = sources.withColumn("pos", F.regexp_extract("source_id", "[0-9]+", 0).try_cast("int"))
    return jobs.run_batches(specs, j.job_id, sources, template, _callable(a.provider), not a.no_split, gate=gate, asking=asking, **who)


def _run(spark, a, j, out, who):
    """Runs a job; the output is written whether right or not. Lines about what is wrong with it."""
    gate = _gate(a, j)
    if a.mode == "stub":
        made = jobs.run_stub(_specs(spark, j.spec_file), j.job_id, out, a.generated_at, **who)
    else:
        sinks.write_json(_generated(spark, a, j, who), out)
        made = spark.read.text(out).withColumnRenamed("value", "json")  # what was answered, not asked anew
    return _wrong(made, j.job_id, gate)


def _run_countries(spark, a, listed):
    """Scans, runs and renders every country folder; a report by country. Whether any failed."""
    jobs_of = {j.job_id: j for j in listed.collect()}  # the registry: a few rows
    names = spark.read.option("header", "true").csv(a.names) if a.names else None

    def prepare(iso3):
        where = f"{a.out}/sources/{iso3}"
        jobs.scan_sources(spark, f"{a.folder}/{iso3}").write.mode("overwrite").parquet(where)
        return where

    def make(job_id, country, sources):
        j, who = jobs_of[job_id], {"country_name": country["country_name"], "country_iso3": country["country_iso3"]}
        where = f"{a.out}/outputs/{country['country_iso3']}/{job_id}"
        if a.mode == "stub":
            jobs.run_stub(_specs(spark, j.spec_file), job_id, where, a.generated_at, **who)
        else:
            sinks.write_json(_generated(spark, argparse.Namespace(**vars(a) | {"sources": sources}), j, who), where)
        return spark.read.text(where).withColumnRenamed("value", "json")

    def render(job_id, iso3, made):
        jobs.render(made, job_id, f"{a.out}/rendered/{iso3}/{job_id}")

    catalogue = f"{a.out}/catalogue"
    found = countries.country_folders(spark, a.folder, names)
    for iso3, job_id, status in countries.run_countries(spark, found, list(jobs_of), prepare, make, lambda j: _gate(a, jobs_of[j]), catalogue, render):
        print(f"{iso3} {job_id}: {status}")
    report = countries.summary(countries.latest_runs(countries.read_catalogue(spark, catalogue))).orderBy("country_iso3").collect()
    for r in report:
        print(f"{r['country_iso3']}: {'SUCCESS' if r['success'] else 'FAILED'}, {r['jobs']} jobs, {r['failed']} failed, {r['seconds']:.0f} s")
    if not report:
        raise FileNotFoundError(f"no country folder under {a.folder}")
    return any(not r["success"] for r in report)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evispark")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(*a, **k) for a, k in args)][0]
    opt = lambda *a, **k: (a, k)
    reg, job, out = opt("--registry", required=True), opt("--job", required=True), opt("--out", required=True)
    country = (opt("--country-name"), opt("--country-iso3"), opt("--generated-at", default=date.today().isoformat()))
    gates = (opt("--strict-citations", action="store_true"), opt("--allowed-sources"))
    add("validate", job, opt("--payload", required=True), opt("--registry"), *gates)
    llm = (opt("--mode", choices=("stub", "llm"), default="stub"), opt("--provider"), opt("--embedder"), opt("--sources"), opt("--index"), opt("--no-split", action="store_true"), opt("--topk", type=int, default=40), opt("--pause", type=float, default=generation.PAUSE), opt("--store"))
    add("run", reg, job, out, *country, *llm, *gates)
    add("run-all", reg, out, *country, *llm, *gates)
    add("run-countries", reg, out, opt("--folder", required=True), opt("--names"), *country, *llm, *gates)
    add("render-all", reg, out, opt("--mode", default="stub"))
    add("render", job, opt("--payload", required=True), out, opt("--form", choices=("md", "csv", "xlsx", "docx"), default="md"))
    add("render-files", job, opt("--payloads", required=True), out, opt("--form", choices=("md", "xlsx", "docx"), default="md"))
    add("prompt", reg, job, out, *country)
    form = opt("--form", choices=("parquet", "json"), default="parquet")
    add("sources-scan", opt("--folder", required=True), out, form)
    add("sources-index", opt("--sources", required=True), opt("--embedder", required=True), opt("--model", default="custom"), out, form)
    add("similarity", opt("--table", required=True), opt("--target", required=True), out, opt("--weights"), opt("--sheet"), opt("--peer-filter", action="store_true"))
    add("comparator", opt("--table", required=True), opt("--target", required=True), out, opt("--topk", type=int, default=20), opt("--aspirational-k", type=int, default=20), opt("--weights"), opt("--sheet"))
    a = p.parse_args(argv)
    spark = get_session()
    try:
        if a.command == "validate":
            j = registry.job(registry.load_registry(spark, a.registry), a.job) if a.registry else None
            bad = _wrong(files.read_json_strict(spark, a.payload), a.job, _gate(a, j))
            print("\n".join(bad) or "valid")
            return 3 if bad else 0
        if a.command == "sources-scan":
            scanned = jobs.scan_sources(spark, a.folder)
            sinks.write_sources_json(scanned, a.out) if a.form == "json" else scanned.write.mode("overwrite").parquet(a.out)
            return 0
        if a.command == "comparator":
            similar, aspirational = comparator.comparator_index(files.read_table(spark, a.table, a.sheet), a.target, a.topk, a.aspirational_k, weights=a.weights)
            sinks.write_csv(similar, f"{a.out}/similar")
            sinks.write_csv(aspirational, f"{a.out}/aspirational")
            return 0
        if a.command == "sources-index":
            jobs.index_sources(spark.read.parquet(a.sources), _callable(a.embedder), a.out, a.model, a.form)
            return 0
        if a.command == "similarity":
            found = comparator.similarity_index(files.read_table(spark, a.table, a.sheet), a.target, peer_columns=comparator.PEER_COLUMNS if a.peer_filter else (), weights=a.weights)
            sinks.write_csv(found, a.out)
            return 0
        if a.command == "render":
            jobs.render(files.read_json_strict(spark, a.payload), a.job, a.out, a.form)
            return 0
        if a.command == "render-files":
            jobs.render_files(files.read_json_strict(spark, a.payloads), a.job, a.out, a.form)
            return 0
        listed = registry.load_registry(spark, a.registry)
        if a.command == "prompt":
            j = registry.job(listed, a.job)
            template = files.read_templates(spark, j.prompt_template).first()["template"]
            sinks.write_text(prompts.job_prompt(_specs(spark, j.spec_file), template, a.job, a.country_name, a.country_iso3), "prompt", a.out)
            return 0
        who = {"country_name": getattr(a, "country_name", None), "country_iso3": getattr(a, "country_iso3", None)}
        if a.command == "run":
            wrong = _run(spark, a, registry.job(listed, a.job), a.out, who)
            print("\n".join(wrong), file=sys.stderr)
            return 3 if wrong else 0
        if a.command == "run-countries":
            return int(_run_countries(spark, a, listed))
        failed = False
        for j in listed.collect():  # the registry: a few rows
            try:
                if a.command == "run-all":
                    if wrong := _run(spark, a, j, f"{a.out}/{j.job_id}", who):
                        failed = True
                        print(f"{j.job_id}: FAILED {wrong[0]}")
                        continue
                else:
                    newest = files.latest_outputs(spark, j.output_dir, a.mode).first()
                    if newest is None:
                        failed = True
                        print(f"{j.job_id}: SKIP")
                        continue
                    jobs.render(files.read_json_strict(spark, newest["path"]), j.job_id, f"{a.out}/{j.job_id}")
                print(f"{j.job_id}: SUCCESS")
            except Exception as e:
                failed = True
                print(f"{j.job_id}: ERROR {e}")
        return int(failed)
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
