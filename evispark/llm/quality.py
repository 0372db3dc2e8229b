"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Every document has a vector of transformed statistics. Minimum-covariance-determinant estimates of its group's
centre and spread come from concentration steps out of several fixed starts, of which the least determinant wins;
a vector at too large a Mahalanobis distance from its group's centre is rejected. All of it is SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise, numbered, settled, without

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"

#: Name -> the least spread (standard deviation) a group is taken to have in it. Most clean texts have no
#: symbol and no repeated line at all; without a floor their covariance is singular and any symbol an outlier.
FEATURES = {"symbol_rate": 0.05, "word_length": 0.25, "dup_line_share": 0.08, "repeat_share": 0.08, "capital_share": 0.04}
#: Statistics are fixed-point numbers, so that their sums don't depend on the order of adding.
UNIT = 1e-4
#: Share of a group that the estimates rest on.
CORE = 0.75
#: Concentration steps of every start, and the most that the best of them takes.
TRIED, MOST_STEPS = 2, 24
#: Squared Mahalanobis distance beyond which a vector is rejected: far beyond chi-square(5) quantiles, since
#: short texts scatter more than a normal law has it (0.999999 would be 36).
CUTOFF = 45.0
#: Groups with fewer rows use their language's estimates, then those of all rows; fewer rows than that: no verdict.
LEAST_GROUP = 200
#: Estimates of at most so many groups (of two dozen numbers each) are broadcast; those of more are joined by shuffle.
MOST_GROUPS = 50_000
#: Bins of the histogram of distances for each doubling of 1 + distance.
BINS = 16


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row of ``docs``: row_no, id, g0, g1 and the counts of the base rules; one pass, no shuffle.

    A word is a run without ASCII white space; null text has none. Words in repeated windows: hashes of
    all windows of three words are sorted with their places; those equal to a neighbour are repeated, and each
    adds as many words as it reaches beyond the one before.
    """
    ws = r"[\x20\x09-\x0D]+"
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = numbered(
        docs,
        F.col(id_col).alias("id"),
        *(F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"g{i}") for i, g in enumerate(groups)),
        t.alias("t"),
        F.array_remove(F.split(t, ws), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    w = F.col("w")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    rows = rows.select(
        "row_no", "id", *(f"g{i}" for i in range(len(groups))),
        F.size(w).cast("long").alias("n_words"),
        (F.length("t") - _removed(F.col("t"), WHITE)).cast("long").alias("word_chars"),
        _removed(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        _removed(F.col("t"), CAPITALS).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > 3, F.sort_array(windows)).alias("s"),
    )
    s = F.col("s")
    again = F.sort_array(
        F.transform(
            F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["p"],
        )
    )
    covered = F.aggregate(
        again,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")


def _vector() -> dict[str, Column]:
    n, share = F.greatest(F.col("n_words"), F.lit(1)), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    x = {
        "symbol_rate": F.log1p(F.col("n_symbols") / n),
        "word_length": F.col("word_chars") / n,
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": F.col("n_repeat_words") / n,
        "capital_share": share("n_capitals", "word_chars"),
    }
    return {k: F.round(x[k] / UNIT).cast("long") for k in FEATURES}


def _cholesky(groups: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """Adds the factor ``l<i><j>`` of a covariance given by its lower triangle, and the logarithm of its determinant."""
    out, d = groups, len(FEATURES)
    for i, f in enumerate(FEATURES):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FEATURES[f] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, d)), 2 * F.log(F.col("l00"))))


_ESTIMATE = ["g", "start", "size", "logdet", *(f"m{i}" for i in range(len(FEATURES))), *(f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1))]


def _with_distance(rows: DataFrame, params: DataFrame, keep: list[str], total: int, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distances ``d2`` by each estimate of a row's ``g``: forward substitution in the factor, a column a step."""
    if params.count() <= MOST_GROUPS:
        joined = rows.join(F.broadcast(params), "g", how)
    elif how == "inner":
        joined = join_hot(rows, params, "g", "size", total)
    else:
        joined = join_hot(rows.where("g IS NOT NULL"), params, "g", "size", total).unionByName(rows.where("g IS NULL"), allowMissingColumns=True)
    for i, f in enumerate(FEATURES):  # one column after another, else each z is written out many times
        rest = F.col(f) * UNIT - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        joined = joined.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return joined.select(*keep, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(FEATURES))), F.col("z0") * F.col("z0")).alias("d2"))


#: CORE / P(chi-square(7) <= the CORE quantile of chi-square(5)), for CORE = 0.75.
CONSISTENT = 1.39


def _params(moments: DataFrame, factor: float = CONSISTENT) -> DataFrame:
    """Centre and factor of the covariance per group and start, from sums of fixed-point numbers.

    The core's spread is smaller than the group's: ``factor`` makes it consistent for normal data.
    """
    out, cov = moments, {}
    for i, f in enumerate(FEATURES):
        out = out.withColumn(f"m{i}", F.col(f"s_{f}").cast("double") * UNIT / F.col("n"))
    for i, f in enumerate(FEATURES):
        for j, e in enumerate([*FEATURES][: i + 1]):
            raw = F.col(f"q_{f}_{e}").cast("double") * UNIT * UNIT / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            cov[i, j] = raw * factor + (FEATURES[f] ** 2 if i == j else 0.0)
    return _cholesky(out, cov).select(*_ESTIMATE)


def _product(f: str, e: str) -> Column:
    """Of two statistics, exactly: only a word's length has no bound, and its square may exceed a long."""
    if f == e == "word_length":
        return F.col(f).cast("decimal(19,0)") * F.col(e).cast("decimal(19,0)")
    return (F.col(f) * F.col(e)).cast("decimal(20,0)")


def _sums() -> list[Column]:
    names = list(FEATURES)
    sums = [F.sum(F.col(f).cast("decimal(20,0)")).alias(f"s_{f}") for f in names]
    return sums + [F.sum(_product(f, e)).alias(f"q_{f}_{e}") for i, f in enumerate(names) for e in names[: i + 1]]


def _core_moments(binned: DataFrame) -> DataFrame:
    """Sums over the nearest bins of each group and start, as many as hold CORE of its rows."""
    by_bin = binned.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
    total = Window.partitionBy("g", "start")
    before = total.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = by_bin.withColumn("size", F.sum("n").over(total)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cols = [c for c in by_bin.columns if c not in ("g", "start", "bin")]
    return cut.where(F.col("before") < F.ceil(F.col("size") * CORE)).groupBy("g", "start", "size").agg(*(F.sum(c).alias(c) for c in cols))


def _concentrated(members: DataFrame, params: DataFrame, total: int) -> DataFrame:
    """One concentration step: the estimates from the rows that are nearest by the estimates before."""
    placed = _with_distance(members, params, ["g", "start", *FEATURES], total)
    return _params(_core_moments(placed.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * BINS).cast("int"))))


#: Bins of a statistic's histogram are a twentieth of its floor wide up to so many, then so many for each doubling.
FINE, COARSE = 2_000, 64


def _medians(members: DataFrame) -> DataFrame:
    """Per group and statistic i: median ``m<i>`` and spread ``d<i>`` by the quartile range, from histograms of bounded length."""
    place = lambda f: F.col(f) * UNIT * (20 / FEATURES[f])
    bin_ = lambda x: F.when(x < FINE, F.floor(x)).otherwise(FINE + F.floor(F.log2(F.greatest(x, F.lit(1.0)) / FINE) * COARSE)).cast("long")
    value = lambda b: F.when(b < FINE, b + 0.5).otherwise(FINE * F.pow(F.lit(2.0), (b - FINE + 0.5) / COARSE))
    long = members.select("g", F.posexplode(F.array(*(bin_(place(f)) for f in FEATURES))).alias("i", "bin"))
    by_bin = long.groupBy("g", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g", "i")
    upto = by_bin.withColumn("size", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin")))
    at = lambda q: value(F.min(F.when(F.col("upto") >= F.ceil(F.col("size") * q), F.col("bin"))))
    q = upto.groupBy("g", "i", "size").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    of = lambda i, x: F.max(F.when(F.col("i") == i, x))
    return q.groupBy("g", "size").agg(
        *(of(i, F.col("mid") * (FEATURES[f] / 20)).alias(f"m{i}") for i, f in enumerate(FEATURES)),
        *(of(i, F.greatest((F.col("hi") - F.col("lo")) * (FEATURES[f] / 20) / 1.349, F.lit(FEATURES[f]))).alias(f"d{i}") for i, f in enumerate(FEATURES)),
    )


def _starts(members: DataFrame, total: int) -> DataFrame:
    """First estimates of each group, three: medians and quartile ranges; medians and the correlations of
    what tanh leaves of the standardised statistics; mean and covariance of all rows.
    """
    names, medians = list(FEATURES), materialise(_medians(members))
    zero = {(i, j): F.col(f"d{i}") ** 2 if i == j else F.lit(0.0) for i in range(len(names)) for j in range(i + 1)}
    by_range = _cholesky(medians.withColumn("start", F.lit(0)), zero).select(*_ESTIMATE)
    joined = members.join(F.broadcast(medians), "g") if medians.count() <= MOST_GROUPS else join_hot(members, medians, "g", "size", total)
    for i, f in enumerate(names):
        joined = joined.withColumn(f"t{i}", F.round(F.tanh((F.col(f) * UNIT - F.col(f"m{i}")) / F.col(f"d{i}")) / UNIT).cast("long"))
    bent = [F.sum(f"t{i}").alias(f"t{i}") for i in range(len(names))]
    bent += [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"u{i}{j}") for i in range(len(names)) for j in range(i + 1)]
    own = ["size", *(f"{k}{i}" for i in range(len(names)) for k in "md")]
    sums = materialise(joined.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in own), *_sums(), *bent))
    by_all = _params(sums.drop(*(f"m{i}" for i in range(len(names)))).withColumn("start", F.lit(2)), 1.0)
    co = lambda i, j: F.col(f"u{i}{j}") / F.col("n") - F.col(f"t{i}") / F.col("n") * F.col(f"t{j}") / F.col("n")
    cov = {}
    for i in range(len(names)):
        for j in range(i):
            both = F.sqrt(co(i, i) * co(j, j))
            cov[i, j] = F.when(both > 0, co(i, j) / both).otherwise(0.0) * F.col(f"d{i}") * F.col(f"d{j}")
        cov[i, i] = F.col(f"d{i}") ** 2
    by_tanh = _cholesky(sums.withColumn("start", F.lit(1)), cov).select(*_ESTIMATE)
    return by_range.unionByName(by_tanh).unionByName(by_all)


def least_determinants(members: DataFrame, total: int) -> DataFrame:
    """The estimate of least determinant per group of ``members`` (g and the statistics).

    Concentration steps from each start; after TRIED of them the start with the least determinant goes on,
    until no group's determinant falls any more, MOST_STEPS at most.
    """
    params = materialise(_starts(members, total))
    for _ in range(TRIED):
        params = materialise(_concentrated(members, params, total))
    least = params.groupBy("g").agg(F.min_by(F.struct(*_ESTIMATE[1:]), F.struct("logdet", "start")).alias("v"))
    best = materialise(least.select("g", "v.*"))
    for _ in range(MOST_STEPS - TRIED):
        new = _concentrated(members, best, total).select("g", F.struct(*_ESTIMATE[1:]).alias("new"))
        old = best.select("g", F.struct(*_ESTIMATE[1:]).alias("old"))
        falls = F.col("new")["logdet"] < F.col("old")["logdet"] - 1e-9
        both = materialise(old.join(new, "g").select("g", falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("v")))
        best = both.select("g", "v.*")
        if not both.where("falls").take(1):
            break
    return best


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs``: row_no, id, the base counts, ``base_failed``, ``distance2`` and ``kept``.

    A row is held against the estimates of its (language, source) if that has LEAST_GROUP rows, else of its
    language, else of all rows, each made over every row of it; estimates that no row needs aren't made. Groups
    are summed by histogram bins, so one with a third of all rows is as cheap as any other. With fewer rows in
    all there is no verdict: distance2 is null and the base rules decide alone.

    Defined results: null text has no words and fails the base; null language or source is the
    group ''; repeated rows each have a row; an empty table gives no rows; other columns are ignored.
    """
    stats = materialise(text_statistics(docs, id_col, text_col, (lang_col, source_col)).withColumn("own", F.concat(F.length("g0").cast("string"), F.lit(":"), "g0", "g1")))
    total = stats.count()
    groups = stats.groupBy("own", "g0").agg(F.count(F.lit(1)).alias("n"))
    by_lang = groups.groupBy("g0").agg(F.sum("n").alias("n_lang"))
    enough = [F.col(n) >= LEAST_GROUP for n in ("n", "n_lang")]
    level = F.when(enough[0], 2).when(enough[1], 1).otherwise(0 if total >= LEAST_GROUP else -1)
    level = groups.join(by_lang, "g0").withColumn("level", level)
    needed = level.groupBy("g0").agg(F.bool_or(F.col("level") == 1).alias("lang"))
    all_rows = F.lit(bool(level.where("level = 0").take(1)))
    name = {2: F.concat(F.lit("2"), "own"), 1: F.concat(F.lit("1"), "g0"), 0: F.lit("0")}
    belongs = F.array_compact(F.array(F.when(F.col("level") == 2, name[2]), F.when(F.col("lang"), name[1]), F.when(all_rows, name[0])))
    judge = F.when(F.col("level") == 2, name[2]).when(F.col("level") == 1, name[1]).when(F.col("level") == 0, name[0])
    table = materialise(level.join(needed, "g0").select("own", "n", belongs.alias("belongs"), judge.alias("g")))
    rows = stats.select("*", *(v.alias(k) for k, v in _vector().items()))
    rows = rows.join(F.broadcast(table), "own") if table.count() <= MOST_GROUPS else join_hot(rows, table, "own", "n", total)
    counts = ["row_no", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if total < LEAST_GROUP:
        judged = rows.select(*counts, F.lit(None).cast("double").alias("d2"))
    else:
        best = settled(lambda: least_determinants(rows.select(F.explode("belongs").alias("g"), *FEATURES), total))
        judged = _with_distance(rows.select("g", *counts, *FEATURES), best, counts, total, "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(
        "row_no", F.col("id").alias(id_col), *counts[2:], failed.alias("base_failed"), F.round("d2", 3).alias("distance2"),
        (~failed & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that ``quality_rules`` rejects; all columns stay, whatever their names.

    Nulls and repeated rows as there; an empty table stays empty.
    """
    return without(docs, lambda d: quality_rules(d, id_col, text_col, lang_col, source_col).where("NOT kept"))
