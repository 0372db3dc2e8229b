"""What the plans must look like at scale."""

import contextlib
import io

from evispark import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_top_k_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(spark, "retrieve_topk")
    assert "WindowGroupLimit" in plan(spark, "retrieve_topk_per_query")


def test_map_side_operators_do_not_shuffle(spark):
    for name in ("flatten_snippets", "chunk_documents", "markdown_rows", "rag_query_text", "citation_clean", "evidence_union_check", "slugify_titles"):
        assert "Exchange" not in plan(spark, name), name


def test_groups_are_combined_before_one_shuffle(spark):
    for name in ("dedup_citations", "latest_per_group", "status_summary", "chunk_stats"):
        p = plan(spark, name)
        assert p.count("Exchange\n") + p.count("Exchange (") <= 2 and "partial_" in p, name  # the tree and its details


def test_scans_read_only_what_is_used(spark):
    p = plan(spark, "latest_per_group")
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "html" not in plan(spark, "citation_clean").split("ReadSchema")[1].split("\n")[0]
