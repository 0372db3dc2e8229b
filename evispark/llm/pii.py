"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Built from SQL functions only. A pattern's matches and the pieces between them (``regexp_extract_all`` and
``split`` by the same pattern) have the lengths from which every span's place follows.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread

#: Fixed patterns of the base kinds. The groups before them only keep a long run of one class of characters
#: from being tried at each of its places: an attempt inside a run fails exactly when that at its start fails.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds that the method adds.
#: Length of an account number by country; of other countries any length that the check digits confirm is taken.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL|BY|SV",
    29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC",
}
#: Where a word of ASCII starts and ends. (What the pattern for word boundaries takes for a word depends on the JVM's version.)
_FROM, _TO = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_GROUPS = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
_KNOWN = "|".join(IBAN_LENGTHS.values())
IBAN = rf"{_FROM}(?:{_GROUPS}){_TO}|{_FROM}" + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _TO
NATIONAL_ID = _FROM + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _TO
#: Fixed patterns: keys of services by their public prefixes, and long random words, which count after a word that names them.
API_KEY = _FROM + "(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z]{10,48}|AIza[0-9A-Za-z_]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,64})" + _TO
SECRET = _FROM + "[0-9A-Za-z_]{20,}" + _TO

OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number has its check digits right: ISO 7064 mod 97-10."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1)


def _iban_part(m: Column) -> Column:
    """How much of a match is an account number: all of it, or for countries of no known length up to a blank."""
    ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda n: (n == F.length(m)) | (F.substr(m, n + 1, F.lit(1)) == " "))
    return F.when(_mod97(m), F.length(m)).when(
        ~F.rlike(m, F.lit(f"^(?:{_KNOWN})")), F.get(F.filter(ends, lambda n: _mod97(F.substr(m, F.lit(1), n))), F.lit(0))
    )


@dataclass(frozen=True)
class Kind:
    """What proposes and confirms a kind of personal data.

    ``score`` holds for a confirmed match, ``context`` more is added if one of ``words`` is among the
    ``near`` characters before it: for base kinds those since the match before, for added kinds all, and the context
    of a match holds for those that follow it with no letter between, as in a list. Spans of added kinds need
    ``threshold`` to count. ``part`` tells how many characters of a match count, if not all; null if none.
    """

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True
    context: float = 0.2
    near: int = 60
    threshold: float = 0.6
    part: Callable[[Column], Column] | None = None


KINDS = (
    Kind("email", EMAIL, "@", lambda m: F.lit(True), 0.8, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", IP, ".", lambda m: F.rlike(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), 0.6, "ip|host|server|address|addr"),
    Kind("card", CARD, "", lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", PHONE, "+", lambda m: F.length(_digits(m)).between(10, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", IBAN, "", lambda m: _iban_part(m).isNotNull(), 0.8, "iban|account|bank|konto|compte|cuenta", base=False, part=_iban_part),
    Kind("national_id", NATIONAL_ID, "-", lambda m: ~F.rlike(m, F.lit("^(?:000|666|9[0-9]{2})|-00-|-0000$")), 0.45, "ssn|social|security|id", base=False),
    Kind("api_key", API_KEY, "", lambda m: F.lit(True), 0.8, "key|token|secret", base=False),
    Kind("secret", SECRET, "", lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")), 0.45, "token|secret|password|passwd|key|auth|bearer", base=False),
)
CHUNK = 256


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, end, score) of a kind's confirmed matches, in order."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), between.alias("gap"))
    span_type = "struct<start:int,rank:int,end:int,score:double>"
    none, nones = F.expr(f"cast(array() as array<{span_type}>)"), F.expr(f"cast(array() as array<array<{span_type}>>)")

    named = lambda before: F.rlike(F.lower(F.right(before, F.lit(kind.near))), F.lit(rf"(?<![a-z])(?:{kind.words})"))

    def judged(x: Column) -> Column:
        n = F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(
            F.length(x["gap"]).alias("gap"), n.alias("n"), (F.coalesce(kind.part(x["m"]), n) if kind.part else n).alias("part"),
            F.coalesce(x["m"].isNotNull() & kind.confirm(x["m"]), F.lit(False)).alias("ok"),
            *([named(x["gap"]).alias("near")] if kind.base else [F.right(x["gap"], F.lit(kind.near)).alias("before"), F.right(x["m"], F.lit(kind.near)).alias("m"), F.rlike(x["gap"], F.lit(r"\p{L}")).alias("apart")]),
        )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["part"]
        near = x["near"] if kind.base else named(F.concat(acc["tail"], x["before"])) | (acc["near"] & ~x["apart"])
        score = F.round(F.lit(kind.score) + F.when(near, kind.context).otherwise(0.0), 2)
        good = x["ok"] if kind.base else x["ok"] & (score >= kind.threshold)
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), score.alias("score")))
        full = F.size(acc["cur"]) >= CHUNK  # spans gather in chunks: adding one copies a chunk, not all before it
        cur = F.when(~good, acc["cur"]).when(full, one).otherwise(F.concat(acc["cur"], one))
        done = F.when(good & full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        more = [] if kind.base else [
            F.right(F.concat(acc["tail"], x["before"], F.coalesce(x["m"], F.lit(""))), F.lit(kind.near)).alias("tail"), (near & x["ok"]).alias("near"),
        ]
        return F.struct((start + x["n"]).alias("at"), cur.alias("cur"), done.alias("done"), *more)

    more = [] if kind.base else [F.lit("").alias("tail"), F.lit(False).alias("near")]
    start = F.struct(F.lit(0).alias("at"), none.alias("cur"), nones.alias("done"), *more)
    folded = F.aggregate(F.transform(pairs, judged), start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))
    some = F.size(found) > 0
    if kind.hint:
        some = F.contains(text, F.lit(kind.hint)) & some
    return F.when(some, folded).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row of ``docs``: the id and ``found``, an array of (start, rank, end, score).

    Places are in code points, the end exclusive, sorted by start and then by the kind's place in ``kinds``
    (``rank``). Within a kind matches are leftmost and don't overlap; a match that isn't confirmed is dropped
    without another try inside it. Null text is empty; rows repeat as they repeat in ``docs``; an empty table
    gives no rows; other columns are ignored. There is no shuffle.
    """
    rows = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    each = rows.select("id", *(_spans(F.col("t"), k, i).alias(f"s{i}") for i, k in enumerate(kinds)))
    return each.select(F.col("id").alias(id_col), F.sort_array(F.concat(*(f"s{i}" for i in range(len(kinds))))).alias("found"))


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span that ``find_pii`` finds replaced by its kind in brackets; all columns stay.

    Of spans that overlap the first goes by its kind, and the others' rest stays. Null text stays null.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = F.sort_array(F.concat(*(_spans(t, k, i) for i, k in enumerate(kinds))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)").alias("kept"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(s["end"].alias("at"), F.array_append(a["kept"], F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).alias("kept"))
    )
    kept = F.aggregate(found, start, step, lambda a: a["kept"])
    rows = docs.withColumn(mine := fresh(docs, "__spans"), kept)
    k, names = F.col(mine), F.array(*(F.lit(f"[{k.name}]") for k in kinds))
    since = lambda i: F.coalesce(F.get(k, i - 1)["end"], F.lit(0))
    parts = F.transform(k, lambda s, i: F.concat(F.substr(t, since(i) + 1, s["start"] - since(i)), F.get(names, s["rank"])))
    text = F.concat(F.array_join(parts, ""), F.substr(t, since(F.size(k)) + 1))
    return rows.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text)).drop(mine)


def digest(found: DataFrame, id_col: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """What the query returns: counts and digest of the base kinds, all spans joined, their number and their scores."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    n_base = sum(k.base for k in kinds)
    f = F.col("found")
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        id_col,
        *(_count(f, i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base),
        F.sha2(said(F.filter(f, lambda s: s["rank"] < n_base)), 256).alias("base_sha256"),
        said(f).alias("spans"),
        F.size(f).cast("long").alias("n_spans"),
        F.array_join(F.transform(f, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
