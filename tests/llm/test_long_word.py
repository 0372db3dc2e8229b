"""Quality rules on one very long text without white space."""

import random

from evispark.llm import quality


def test_a_megabyte_without_white_space(spark):
    r = random.Random(14)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(80)) for _ in range(250)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, "x" * 1_000_000])], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality.quality_rules(docs).collect()}
    assert got[250]["word_chars"] == 1_000_000 and got[250]["base_failed"] and got[250]["distance2"] > quality.CUTOFF
    assert sum(got[i]["kept"] for i in range(250)) == 250
