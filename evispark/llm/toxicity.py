"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread

#: The classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: A word enters the lexicon if that many different texts have it, most of them toxic, so many standard
#: deviations above chance; and the most words a lexicon has.
LEAST_TEXTS, LEAST_Z, MOST_WORDS = 6, 5.0, 1_000
#: Texts whose words are listed at once.
STEP = 200
#: How near, in words, a second person counts as aimed at.
NEAR = 6
#: Fixed list: words that address the reader, in the languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros"

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32) for c in range(256))
_LEET = dict(zip(b"013457@$!|", b"oieastasii", strict=True))
_UNMASKED = bytes(_LEET.get(c, _PLAIN[c]) for c in range(256))
#: What is put between letters to hide a word.
_FILL = b"*._-~'\""
#: Chunks with a sign that may mask a letter, and what may stand around a word without masking it.
_MARKED, _EDGE = re.compile(rb"(?<!\S)[^\s013457@$!|*._\-~'\"]*[013457@$!|*._\-~'\"]\S*"), b".,;:?()[]\"'-_*~"
_CAPITALS, _STOPS, _MARKS = bytes(range(65, 91)), b".,;:", b"!?"

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_weight", "strongest", "near_second_person", "second_person_density", "obfuscated_density",
    "obfuscated_hits", "capital_rate", "mark_rate", "stop_rate", "symbol_rate", "digit_rate", "words",
)


#: Stems: the first bytes of longer words, learnt like words; so unseen endings of a known insult count.
_STEM = 7


def _weight(word: bytes, lexicon: dict[bytes, float]) -> float | None:
    return lexicon.get(word) or (lexicon.get(b"^" + word[:_STEM]) if len(word) > _STEM else None)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _hidden(raw: bytes, lexicon: dict[bytes, float]) -> int:
    """How many chunks of text hold no known word as they stand, but one once masking signs are read as letters or left out."""
    n = 0
    for chunk in _MARKED.findall(raw) if lexicon else ():
        inner = chunk.strip(_EDGE)
        if not inner.isalpha() and any(_weight(w, lexicon) for w in inner.translate(_UNMASKED, _FILL).split()):
            n += not any(_weight(w, lexicon) for w in inner.translate(_PLAIN).split())
    return n


def features(text: str, lexicon: dict[bytes, float], second: frozenset[bytes]) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_PLAIN).split()
    n, size = max(1, len(words)), max(1, len(raw))
    found = [(i, x) for i, w in enumerate(words) if (x := _weight(w, lexicon))]
    hits, weights = [i for i, _ in found], [x for _, x in found]
    you = [i for i, w in enumerate(words) if w in second]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        y = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(np.abs(y[at] - hits), np.abs(y[at + 1] - hits)) <= NEAR).sum())
    hidden = _hidden(raw, lexicon)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(hits) / n, np.log1p(len(hits)), sum(weights) / n, max(weights, default=0.0), near / n, len(you) / n, hidden / n, np.log1p(hidden),
        without(_CAPITALS) / size, without(_MARKS) / size, without(_STOPS) / size, without(b"#*$%&|<>@") / size, without(b"0123456789") / size, np.log1p(len(words)),
    )


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on features cut into quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:])) for j in range(x.shape[1])]
        rare = [np.unique(x[:, j][x[:, j] > 0]) for j in range(x.shape[1])]  # values of features that are mostly 0
        self.cuts = [np.unique(np.r_[c, np.quantile(r, np.linspace(0, 1, 9))]) if len(r) else c for c, r in zip(self.cuts, rare, strict=True)]
        b = self._cut(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.forest = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree, out = self._grow(b, y - p, p * (1 - p))
            self.forest.append(tree)
            f += out
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """Nodes (feature, last bin to the left, left, right) or (value,)."""
        nodes: list = [None]
        out, todo = np.zeros(len(g)), [(0, np.arange(len(g)), 0)]
        while todo:
            k, rows, level = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < self.depth:
                for j, c in enumerate(self.cuts):
                    gs = np.cumsum(np.bincount(b[rows, j], g[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(hs < self.least) | (total_h - hs < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), (j, int(gain.argmax())))
            if best[1] is None:
                value = self.rate * total_g / (total_h + self.ridge)
                nodes[k] = (value,)
                out[rows] = value
                continue
            j, cut = best[1]
            left = b[rows, j] <= cut
            nodes[k] = (j, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[left], level + 1), (len(nodes) + 1, rows[~left], level + 1)]
            nodes += [None, None]
        return nodes, out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._cut(x)
        f = np.full(len(x), self.base)
        for nodes in self.forest:
            todo = [(0, np.arange(len(x)))]
            while todo:
                k, rows = todo.pop()
                if len(nodes[k]) == 1:
                    f[rows] += nodes[k][0]
                    continue
                j, cut, a, c = nodes[k]
                left = b[rows, j] <= cut
                todo += [(a, rows[left]), (c, rows[~left])]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the rising step fit: pooled adjacent violators over equal scores combined."""
    at, inverse = np.unique(score, return_inverse=True)
    n, s = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # sum, count, last index
    for i in range(len(at)):
        blocks.append([s[i], n[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], top[2]]
    value, first = np.zeros(len(at)), 0
    for total, count, last in blocks:
        value[first : int(last) + 1] = total / count
        first = int(last) + 1
    return at, value


@dataclass
class Model:
    lexicon: dict[bytes, float]
    second: frozenset[bytes]
    trees: Boosted | None
    at: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t, self.lexicon, self.second) for t in texts]))
        # the trees' own order is kept inside a step of the calibration
        return np.clip(np.interp(margin, self.at, self.value) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0, 1)


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, y, sign) of rows (t, y): each word or stem of each text, with the text's smallest hash of three words; ``STEP`` texts at a time.

    What different steps have in common repeats, so only distinct rows may be counted.
    """
    for batch in (b.iloc[at : at + STEP] for b in batches for at in range(0, len(b), STEP)):
        found: dict[tuple[bytes, int, int], int] = {}
        for t, y in zip(batch["t"], batch["y"], strict=True):
            w = words_of(t)
            sign = min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1
            w += [b"^" + x[:_STEM] for x in w if len(x) > _STEM]
            for x in {x for x in w if len(x) > 2 and x.lstrip(b"^").decode("utf-8", "ignore").isalpha()}:
                found[x, y, sign] = 1
        yield pd.DataFrame([(x, y, sign) for x, y, sign in found], columns=["w", "y", "sign"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on labelled rows of ``docs``, at most ``sample`` of them.

    Rows of ``labels`` with a null id or label are left out; an id labelled twice counts as toxic if either
    says so. The lexicon comes from the same rows: words that different texts have mostly when toxic
    (near copies, texts that share their smallest hash of three words, count once).
    With fewer than 20 rows, or one class only, scores are the share of toxic rows (0.5 without any).
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("id").cast("string")), "id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialise(rows.join(F.broadcast(materialise(chosen)), "id"))  # at most ``sample`` rows

    by_word = rows.mapInPandas(signed, "w binary, y int, sign long").groupBy("w", "y").agg(F.approx_count_distinct("sign", 0.02).alias("n"))
    both = by_word.groupBy("w").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    seen = rows.groupBy("y").agg(F.countDistinct(F.md5("t")).alias("n")).collect()
    n, toxic = sum(r["n"] for r in seen), sum(r["n"] for r in seen if r["y"] > 0)
    prior = toxic / n if n else 0.5
    nothing = Model({}, frozenset(), None, np.zeros(0), np.zeros(0), prior)
    if n < 20 or toxic in (0, n):
        return nothing
    z = (F.col("a") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    words = both.where((F.col("a") >= LEAST_TEXTS) & (F.col("a") >= 0.5 * F.col("n")) & (z >= LEAST_Z)).select("w", "a", "n", z.alias("z"))
    words = words.orderBy(F.desc("z"), "w").limit(MOST_WORDS).collect()
    lexicon = {bytes(r["w"]): float(np.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5)) - np.log(prior / (1 - prior))) for r in words}
    second = frozenset(w.encode() for w in SECOND_PERSON.split())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pd.DataFrame([features(t, lexicon, second) for t in batch["t"]], columns=FEATURES)
            yield x.assign(y=batch["y"].to_numpy(), fold=[xxhash.xxh3_64_intdigest(b" ".join(words_of(t)[:8])) % 4 for t in batch["t"]])

    data = rows.mapInPandas(measured, ", ".join(f"{f} double" for f in FEATURES) + ", y int, fold long").toPandas()  # at most ``sample`` rows
    data = data.sort_values(list(data.columns)).reset_index(drop=True)
    x, y, fold = data[list(FEATURES)].to_numpy(), (data["y"] > 0).to_numpy(float), data["fold"].to_numpy()
    out = np.zeros(len(y))
    for k in range(4):  # copies share their first words and so their fold
        rest = fold != k
        if (fold == k).any():
            out[fold == k] = (Boosted().fit(x[rest], y[rest]) if 0 < y[rest].mean() < 1 else Boosted(trees=0).fit(x, y)).margin(x[fold == k])
    trees = Boosted().fit(x, y)
    at, value = isotonic(out, y)
    return Model(lexicon, second, trees, at, value, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: the id, ``score`` and ``predicted``. Null text is empty; no shuffle; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": model.score(batch["t"].tolist())})

    rows = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = rows.mapInPandas(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
