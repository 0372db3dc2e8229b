"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, exact_dedup, mixing, packing, periodic_runs, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("row_no")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir)).drop("row_no")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(_documents(spark, sf_dir)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir)).drop("row_no", "first")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_documents(spark, sf_dir)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("row_no")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_documents(spark, sf_dir)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(_documents(spark, sf_dir))))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"  # a conversation that says the template's own marks
    hostile = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chat(said.unionByName(hostile)))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_quality_rules, op4_suffix_array_dedup, op5_token_counts, op6_simhash_near_dedup, op7_best_fit_packing, op8_substring_dedup, op9_mixing, op10_pii, op11_periodic_runs, op12_cross_tokenizer_alignment, op13_chat_formatting)}

#: Check digits of an account number ``x`` without blanks: ISO 7064 mod 97-10.
_MOD_97 = "length(x) BETWEEN 15 AND 34 AND list_reduce([0] || list_transform(string_split(x[5:] || x[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, y: CASE WHEN y > 9 THEN a * 100 + y ELSE a * 10 + y END % 97) = 1"
#: Lengths at which a match ``m`` is an account number, longest first: the whole match, or for other countries than those of known lengths its part before a blank.
_PARTS = (
    f"list_filter(list_reverse(range(15, length(m) + 1)), lambda n: (n = length(m) OR (m[n + 1] = ' ' AND NOT regexp_matches(m, '^(?:{'|'.join(pii.IBAN_LENGTHS.values())})'))) AND "
    + _MOD_97.replace("(x", "(replace(m[:n], ' ', '')").replace("x[", "replace(m[:n], ' ', '')[") + ")"
)
#: kind -> (pattern, confirmed, score, context words, threshold), as in ``pii.KINDS``. Matches ``m`` come with the text ``g`` since the one before; ``s`` is a match without blanks.
_PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.8, "mail|contact|write|kontakt|correo|courriel", 0),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"regexp_full_match(m, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}')", 0.6, "ip|host|server|address|addr", 0),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0", 0.7, "card|visa|credit|karte|carte|tarjeta", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15", 0.6, "phone|call|tel|mobile|fax", 0),
    "iban": (re.sub(r"\(\?<?![^)]*\)", r"\\b", pii.IBAN), f"len({_PARTS}) > 0", 0.8, "iban|account|bank|konto|compte|cuenta", 0.6),
    "national_id": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(?:000|666|9[0-9]{2})|-00-|-0000$')", 0.45, "ssn|social|security|id", 0.6),
    "api_key": (r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z]{10,48}|AIza[0-9A-Za-z_]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,64})\b", "true", 0.8, "key|token|secret", 0.6),
    "secret": (r"\b[0-9A-Za-z_]{20,}\b", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')", 0.45, "token|secret|password|passwd|key|auth|bearer", 0.6),
}


def _pii_sql() -> str:
    """Spans by kind. Words near a base match stand after the match before. Those near an added one stand anywhere in the
    60 characters before it, or near the first of a list: a chain of confirmed matches without a letter between.
    """

    def spans(rank: int, kind: str) -> str:
        pattern, good, score, words, least = _PII_SQL[kind]
        named = lambda x: f"regexp_matches(lower(right({x}, 60)), '(^|[^a-z])(?:{words})')"
        chain = "max(chain) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"
        near = named("g") if least == 0 else "bool_or(said) OVER (PARTITION BY doc_id, chain ORDER BY i ROWS UNBOUNDED PRECEDING)"
        places = (
            "SELECT *, list_sum(list_transform(gs[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS start, ms[i] AS m, gs[i] AS g "
            f"FROM (SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM docs))"
        )
        judged = f"SELECT *, {good} AS ok, {named('t[:start]')} AS said FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({places}))"
        if least:
            cut = "coalesce(NOT lag(ok) OVER (PARTITION BY doc_id ORDER BY i) OR regexp_matches(g, '\\p{L}'), true)"
            judged = f"SELECT * REPLACE ({chain} AS chain) FROM (SELECT *, CASE WHEN {cut} THEN i END AS chain FROM ({judged}))"
        end = f"start + coalesce({_PARTS}[1], length(m))" if kind == "iban" else "start + length(m)"
        scored = f"SELECT doc_id, start, {end} AS e, ok, round({score} + CASE WHEN {near} THEN 0.2 ELSE 0.0 END, 2) AS score FROM ({judged})"
        return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, e, score FROM ({scored}) WHERE ok AND score >= {least}"

    found = " UNION ALL ".join(spans(rank, kind) for rank, kind in enumerate(_PII_SQL))
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(list(_PII_SQL)[:4]))
    joined = "string_agg(kind || ':' || start || ':' || e, ',' ORDER BY start, rank)"
    return (
        f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}) "
        f"SELECT doc_id, {counts}, sha256(coalesce({joined} FILTER (rank < 4), '')) AS base_sha256, coalesce({joined}, '') AS spans, count(rank) AS n_spans, "
        "coalesce(string_agg(score::DOUBLE::VARCHAR, ',' ORDER BY start, rank), '') AS scores FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id"
    )


#: Windows of 50 words, judged by the earliest document that has each; a word goes if one of the 50 windows over it does.
_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 49], ' ')) AS first FROM p),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT u.doc_id, u.i, word, coalesce(max((first < g.doc_id)::INT) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM u LEFT JOIN g USING (doc_id, i)),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

#: CRC-32 of the decimal id, bit by bit.
_CRC = "list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda r, x: CASE WHEN xor(r, x) % 2 = 1 THEN xor(xor(r, x) >> 1, 3988292384) ELSE xor(r, x) >> 1 END)"


def _runs_sql(levels: int = 24) -> str:
    """Words that recur at the same distance as their neighbours do: where sequences of 2^k words next recur between 2^(k-1) + 1 and 2^k words on."""
    names = ["SELECT doc_id, i, hash(w) AS g FROM u"] + [
        f"SELECT a.doc_id, a.i, hash(a.g, b.g) AS g FROM r{k - 1} a JOIN r{k - 1} b ON a.doc_id = b.doc_id AND b.i = a.i + {1 << k - 1}" for k in range(1, levels)
    ]
    steps = "".join(
        f"r{k} AS MATERIALIZED (SELECT doc_id, i, g, next FROM (SELECT doc_id, i, g, lead(i) OVER o - i AS next, lag(i) OVER o AS before FROM ({name}) WINDOW o AS (PARTITION BY doc_id, g ORDER BY i)) WHERE next IS NOT NULL OR before IS NOT NULL),\n"
        for k, name in enumerate(names)
    )
    found = " UNION ALL ".join(
        f"SELECT doc_id, min(i) AS start, count(*) + {(1 << k) - 1} + next AS length, next AS period FROM (SELECT doc_id, i, next, i - row_number() OVER (PARTITION BY doc_id, next ORDER BY i) AS island FROM r{k} WHERE next BETWEEN {(1 << k >> 1) + 1} AND {1 << k}) GROUP BY doc_id, next, island"
        for k in range(levels)
    )
    return f"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, xor({_CRC}, 4294967295) AS h FROM documents),
a AS (SELECT doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS k FROM h),
p AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS ws FROM a),
u AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM p),
{steps}runs AS MATERIALIZED (SELECT * FROM ({found}) WHERE length >= greatest(24, 3 * period)),
x AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'less': -(length / period), 'start': start, 'period': period}}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: A turn has its marks' characters, its text's, and one escape for each mark in the text. Only roles that have marks of their own.
_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), m AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 7 END + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?SYS|/?INST|/?ROLE|/TURN)\]')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

ORACLE_SQL = {
    "op13_chat_formatting": _CHAT_SQL,
    "op11_periodic_runs": _runs_sql(),
    "op8_substring_dedup": _SUBSTRING_SQL,
    "op10_pii": _pii_sql(),
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""",
}
