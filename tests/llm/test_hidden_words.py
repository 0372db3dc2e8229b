"""The features of a text against a slow, plain model of them."""

import random
import time

import numpy as np

from evispark.llm import toxicity

LEXICON = {b"nitwit": 2.0, b"scum": 1.5, b"^bastard": 1.0, b"idiot": 3.0}
SECOND = frozenset([b"you", b"your"])
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def weight(word: str) -> float:
    return LEXICON.get(word.encode()) or (LEXICON.get(b"^" + word.encode()[:7]) if len(word) > 7 else None) or 0.0


def plain(text: str) -> list[str]:
    return "".join(c if c in LETTERS + "0123456789" or ord(c) > 127 else " " for c in text.lower()).split()


def unmasked(text: str) -> list[str]:
    shown = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
    kept = [shown.get(c, c) for c in text.lower() if c not in "*._-~'\""]
    return "".join(c if c in LETTERS + "0123456789" or ord(c) > 127 else " " for c in kept).split()


def model(text: str) -> dict[str, float]:
    words = plain(text)
    n, size = max(1, len(words)), max(1, len(text.encode()))
    hits = [i for i, w in enumerate(words) if weight(w)]
    you = [i for i, w in enumerate(words) if w in ("you", "your")]
    hidden = 0
    for chunk in text.split():
        inner = chunk.strip(".,;:?()[]\"'-_*~")
        hidden += not any(map(weight, plain(inner))) and any(map(weight, unmasked(inner)))
    return {
        "lexicon_density": len(hits) / n, "strongest": max((weight(words[i]) for i in hits), default=0.0),
        "near_second_person": sum(any(abs(i - j) <= 6 for j in you) for i in hits) / n, "second_person_density": len(you) / n,
        "obfuscated_hits": np.log1p(hidden), "capital_rate": sum(c in LETTERS.upper() for c in text) / size,
        "mark_rate": sum(c in "!?" for c in text) / size, "digit_rate": sum(c in "0123456789" for c in text) / size, "words": np.log1p(len(words)),
    }


def test_features_against_the_plain_model():
    r = random.Random(2)
    parts = ["nitwit", "N1tw!t,", "n.i.t.w.i.t", "sc*um", "SCUM!", "$cum", "you", "Your,", "bastardly", "b@stardly", "3-4", "word", "idiot's", "1d10t", "é*é", "...", "a.b", "(idi0t)"]
    for _ in range(300):
        text = r.choice([" ", "\n", "  "]).join(r.choice(parts) for _ in range(r.randrange(0, 25)))
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, LEXICON, SECOND), strict=True))
        for k, v in model(text).items():
            assert abs(got[k] - v) < 1e-12, (k, text)


def test_plain_hits_do_not_cancel_hidden_ones():
    got = dict(zip(toxicity.FEATURES, toxicity.features("bastardly bastardly n1tw1t", LEXICON, SECOND), strict=True))
    assert got["lexicon_hits"] == np.log1p(2) and got["obfuscated_hits"] == np.log1p(1)


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "*" * 2_000_000, "a." * 1_000_000):
        start = time.time()
        toxicity.features(text, LEXICON, SECOND)
        assert time.time() - start < 10
