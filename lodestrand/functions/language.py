"""Whether a short text is German or English, by its character n-grams.

Log-odds of hashed n-grams, fitted by `python -m lodestrand.functions.language DOCUMENTS` on at most
SAMPLE texts of known language and stored; n-grams seen in neither language say nothing.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from functools import lru_cache

import numpy as np

MODEL = os.path.join(os.path.dirname(__file__), "language.npz")
BUCKETS, WIDTHS, SAMPLE, WORDS = 1 << 16, (2, 3, 4, 5), 6_000, 400_000
WORD = re.compile(r"[^\W\d_]{2,}")


@lru_cache(maxsize=200_000)
def grams(word: str) -> tuple[int, ...]:
    padded = f" {word} "
    return tuple(zlib.crc32(f"{w}{padded[k : k + w]}".encode()) % BUCKETS for w in WIDTHS for k in range(len(padded) - w + 1))


@lru_cache(maxsize=1)
def _odds() -> np.ndarray:
    with np.load(MODEL) as z:
        return z["odds"].astype(np.float32)


@lru_cache(maxsize=200_000)
def word_odds(word: str) -> float:
    """The mean log-odds of a word's n-grams, positive for German."""
    return float(_odds()[list(grams(word))].mean())


def german_odds(text: str, vague: frozenset[str] = frozenset(), least: float = 0.5) -> float:
    """The sum over all words; `vague` ones, such as units, count only if their own odds are plain."""
    odds = ((w, word_odds(w)) for w in map(str.lower, WORD.findall(text)))
    return sum(x for w, x in odds if w not in vague or abs(x) >= least)


def main(source: str, out: str = MODEL) -> None:
    import pandas as pd

    rows = pd.read_parquet(source, columns=["text", "lang"]).dropna()
    counts = {}
    for name in ("de", "en"):
        texts = rows[rows["lang"].str.strip().str.lower() == name]["text"].tolist()[:SAMPLE]
        words = [w.lower() for t in texts for w in WORD.findall(t) if w.isascii() or not re.search("[一-鿿]", w)][:WORDS]
        # a word counts by the logarithm of how often it occurs, so few frequent ones don't decide all
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        counts[name] = np.zeros(BUCKETS)
        for w, n in seen.items():
            np.add.at(counts[name], list(grams(w)), 1 + np.log(n))
    share = {k: (v + 0.5) / (v.sum() + 0.5 * BUCKETS) for k, v in counts.items()}
    np.savez_compressed(out, odds=np.where(counts["de"] + counts["en"] > 0, np.log(share["de"] / share["en"]), 0).astype(np.float16))


if __name__ == "__main__":
    main(*sys.argv[1:])
