"""Exact dedup, personal data and quality statistics against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evispark.llm import exact_dedup, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, kept string, row_no long, t string, h string"


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None if k % 3 else "en", "s", "clash", 1, "t", "h") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


TEXTS = ["a b", "a  b", "a\tb ", "a b ", None, "", " ", "\n", "é", "x" * 50_000, "x" * 50_000, "a b"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """A weak hash collides all the time; bytes then decide."""
    more = {"content_hash": lambda t: F.length(t)} if weak else {}
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, TEXTS), **more).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_ties_nulls_empty(spark):
    docs = table(spark, ["a", "a", "a", "b"], [None, 5, 5, None]).coalesce(1)
    got = exact_dedup.exact_dedup(docs).orderBy("row_no").collect()
    assert [(r["keep_id"], r["kept"]) for r in got] == [(5, False), (5, True), (5, False), (None, True)]
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["a", "b"]
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


def spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for rank, pattern, good in ((2, r"[0-9]([\x20-]?[0-9])+", lambda d: 14 <= len(d) <= 19 and luhn(d)), (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 10 <= len(d) <= 15)):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, t) if good(re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_against_brute_force(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x.y%z@q-1.com", "@", "a@b", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+", ".", "é😀", " ", "9", "-", "\n", "%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(300)]
    texts += [None, "", "1" * 30_000, "a" * 60_000, "a@b.c " * 700, "1.2.3.4 " * 300, "9 " * 5_000, "a@b.c%d@e.f"]
    got = {x["doc_id"]: x for x in pii.find_pii(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s)[:3] for s in got[i]["found"] if s["rank"] < 4] == spans(t or ""), i


def test_pii_added_kinds_and_redaction(spark):
    texts = ["iban DE89370400440532013000 ok", "iban DE89370400440532013001", "ssn 123-45-6789", "code 123-45-6789", "mail me: a@b.co, 10.0.0.1"]
    docs = table(spark, texts)
    got = pii.digest(pii.find_pii(docs)).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == ["iban:5:27", "", "national_id:4:15", "", "email:9:15,ip:17:25"]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_email"] == got[4]["n_ip"] == 1
    assert pii.redact(docs).orderBy("doc_id").collect()[4]["text"] == "mail me: [email], [ip]"
    assert pii.find_pii(table(spark, [])).count() == 0


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def test_quality_statistics_and_verdict(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n))
    clean = [prose(r.randrange(60, 200)) for _ in range(260)]
    junk = [re.sub(" ", "%%% ", prose(80)) for _ in range(10)]
    odd = [None, "", "a a a a a", "a b c a b c", "x y\nx y\n\n \nx y", "w " * 3_000, prose(20_000), "É É\x0b|É"]
    texts = clean + junk + odd
    got = {x["doc_id"]: x for x in quality.quality_rules(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = counts(t or "")
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n, i
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert all(got[i]["kept"] for i in range(len(clean))) and not any(got[i]["kept"] for i in range(len(clean), len(clean) + len(junk)))


def test_quality_small_and_empty_tables(spark):
    docs = table(spark, ["a b " * 5 + " ".join(f"w{i}" for i in range(60)), "short"])
    got = quality.quality_rules(docs).orderBy("doc_id").collect()
    assert [(r["kept"], r["distance2"]) for r in got] == [(True, None), (False, None)]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 1
    assert quality.quality_rules(table(spark, [])).count() == 0
