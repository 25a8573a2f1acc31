"""Template residue, filler and error notices, found by character n-gram models.

Four Witten-Bell interpolated character models (`lodestrand.llm.residue_fit`) give each character
its probability in natural prose, placeholders, filler and notices. The logarithm of the ratio to
prose, clipped per character, is summed over windows; of each kind of residue the window with the
greatest sum is where the text looks least like prose and most like that kind, and so on with what
lies beside it. A placeholder or blank counts wherever its window's sum passes a threshold, even
inside a real sentence, and holds a sign that ordinary sentences don't have, as letters alone, however
rare, are only words that the models don't know. Filler and notices count if their windows together also cover most of the text, as a text that merely mentions such
words is content.

Texts are read whole, in NFKC with digits alike. There is no shuffle but that of the results,
which drops rows delivered twice. Defined results: null and empty fields and null elements are no residue.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import spread

MODEL = os.path.join(os.path.dirname(__file__), "residue_model.npz")
KINDS = ("placeholder", "filler", "notice")
ORDER, ALPHABET = 5, 4000
CLIP = 4.0
#: The least sum of a window of each kind, and the least share of the text that it must cover.
LEAST_SUM = {"placeholder": 7.8, "filler": 4.5, "notice": 12.0}
LEAST_COVER = {"placeholder": 0.0, "filler": 0.6, "notice": 0.6}
#: A placeholder's least length, and the signs of ordinary sentences, which mark none.
LEAST_LENGTH, SENTENCE = 2, ".,;:!?。、'\"-~·/°+±×="
#: Bytes, about, that the remembered texts of a worker may take.
MEMORY = 64 << 20


def normal(text: str) -> str:
    """What the models read: NFKC, digits alike, white space as single spaces."""
    text = unicodedata.normalize("NFKC", text).translate({ord(c): "0" for c in "123456789"})
    return " ".join(text.split())


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ORDER + 1, characters + 1) of the runs of 0 to ORDER characters that end at each place,
    the end of the text being one, and (ORDER, ...) of the runs that end just before it."""
    padded = "\x02" * (ORDER + 1) + text + "\x03"
    a = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(text) + 2
    out = np.zeros((ORDER + 1, n), np.uint64)
    for k in range(1, ORDER + 1):
        h = (out[k - 1] ^ a[ORDER + 1 - k : ORDER + 1 - k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out[k] = h ^ (h >> np.uint64(32))
    out = (out >> np.uint64(32)).astype(np.uint32)
    return out[:, 1:], out[:ORDER, :-1]


class Model:
    """Of each order: the hashes of runs with their counts, and of contexts with their uses and distinct successors."""

    def __init__(self, tables: list[tuple[np.ndarray, ...]]):
        self.tables = tables

    @classmethod
    def fit(cls, texts: list[str]) -> Model:
        both = [runs(t) for t in texts]
        g, c = (np.concatenate([b[k] for b in both], axis=1) for k in (0, 1))
        tables = []
        for k in range(ORDER):
            keys, counts = np.unique(g[k + 1], return_counts=True)
            contexts, uses = np.unique(c[k], return_counts=True)
            pairs = np.unique(np.stack([c[k], g[k + 1]]), axis=1)
            different = np.unique(pairs[0], return_counts=True)[1]
            tables.append((keys, counts.astype(np.int32), contexts, uses.astype(np.int32), different.astype(np.int32)))
        return cls(tables)


class Places:
    """Where sorted hashes are: the first of each stretch of the upper bits is looked up, then at most the longest stretch walked."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(32 - max(1, min(24, int(len(keys)).bit_length() + 1)))
        starts = np.searchsorted(keys >> self.shift, np.arange((1 << (32 - int(self.shift))) + 1))
        self.first, self.longest = starts[:-1].astype(np.int32), int(np.diff(starts).max(initial=1))
        self.keys = np.append(keys, np.uint32(0xFFFFFFFF))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, the number of keys if it isn't there."""
        at = self.first[wanted >> self.shift]
        for _ in range(self.longest):
            at += self.keys[at] < wanted
        return np.where(self.keys[at] == wanted, at, len(self.keys) - 1)


class Together:
    """Several models over one table of runs and one of contexts per order, so that each run is looked up once for all."""

    def __init__(self, models: dict[str, Model]):
        self.kinds = list(models)
        self.rates = []
        for k in range(ORDER):
            own = [m.tables[k] for m in models.values()]
            keys, contexts = (np.unique(np.concatenate([t[i] for t in own])) for i in (0, 2))
            counts, uses, different = (np.zeros((len(own), len(x)), np.int32) for x in (keys, contexts, contexts))
            for row, t in enumerate(own):
                counts[row, np.searchsorted(keys, t[0])] = t[1]
                at = np.searchsorted(contexts, t[2])
                uses[row, at], different[row, at] = t[3], t[4]
            every = (uses + different).astype(np.float32)
            seen = np.maximum(every, 1)
            beside = lambda x, last: np.ascontiguousarray(np.vstack([x.T, np.full((1, len(own)), last)]).astype(np.float32))
            self.rates.append((Places(keys), beside(counts, 0), Places(contexts), beside(np.where(every > 0, 1 / seen, 0), 0), beside(np.where(every > 0, different / seen, 1), 1)))

    def logs(self, g: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        """The logarithm of each character's probability in each model, by Witten-Bell interpolation."""
        p = np.full((g.shape[1], len(self.kinds)), 1 / ALPHABET, np.float32)
        for k, (runs_of, counts, contexts, total, kept) in enumerate(self.rates):
            at, run = contexts.find(c[k]), runs_of.find(g[k + 1])
            # the last row of each table stands for what isn't there: nothing counted, all of the shorter run's probability kept
            p *= kept[at]
            p += counts[run] * total[at]
        return dict(zip(self.kinds, np.log(p).T))


PARTS = ("keys", "counts", "contexts", "uses", "different")


def save(models: dict[str, Model], path: str) -> None:
    np.savez_compressed(path, **{f"{kind}_{k}_{part}": x for kind, m in models.items() for k, t in enumerate(m.tables) for part, x in zip(PARTS, t)})


def load(path: str = MODEL) -> Together:
    with np.load(path) as z:
        return Together({kind: Model([tuple(z[f"{kind}_{k}_{part}"] for part in PARTS) for k in range(ORDER)]) for kind in ("prose", *KINDS)})


def window(ratio: np.ndarray) -> tuple[int, int, float]:
    """(start, end, sum) of the window with the greatest sum."""
    total = np.r_[0.0, np.cumsum(ratio)]
    low = np.minimum.accumulate(total[:-1])
    gain = total[1:] - low
    end = int(gain.argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end + 1, float(gain[end])


def all_windows(ratio: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, end, sum) of the disjoint windows of at least that sum, in order: the one with the greatest sum,
    and the same again of what lies on either side, found in one pass (Ruzzo and Tompa)."""
    total = np.r_[0.0, np.cumsum(ratio)].tolist()
    low, high, starts, ends, before = [], [], [], [], []
    for i in np.flatnonzero(ratio > 0).tolist():
        a, b, start = total[i], total[i + 1], i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= a:
                j = before[j]
            if j < 0 or high[j] >= b:
                break
            a, start = low[j], starts[j]  # the windows from j on become one
            for x in (low, high, starts, ends, before):
                del x[j:]
        for x, v in ((low, a), (high, b), (starts, start), (ends, i + 1), (before, j)):
            x.append(v)
    return [(s, e, b - a) for s, e, a, b in zip(starts, ends, low, high) if b - a >= least]


def examine(texts: list[str], models: Together) -> list[list[tuple[str, int, int, float, float]]]:
    """(kind, start, end, sum, coverage) of all windows of each kind that reach its least sum over each
    normalised text, else of the best one; coverage is that of a kind's windows together."""
    texts = [normal(t) for t in texts]
    both = [runs(t) for t in texts]
    g, c = (np.concatenate([b[k] for b in both], axis=1) for k in (0, 1))
    logs = models.logs(g, c)
    ratios = {kind: np.clip(logs[kind] - logs["prose"], -CLIP, CLIP) for kind in KINDS}
    out, at = [], 0
    for text in texts:
        own = []
        for kind, ratio in ratios.items() if text else ():
            ratio = ratio[at : at + len(text) + 1]  # the last place is the text's end
            best = window(ratio)
            spans = all_windows(ratio, LEAST_SUM[kind]) if best[2] >= LEAST_SUM[kind] else [best]
            spans = [(min(start, len(text) - 1), min(end, len(text)), total) for start, end, total in spans or [best]]
            cover = sum(end - start for start, end, _ in spans) / len(text)
            own += [(kind, *span, cover) for span in spans]
        out.append(own)
        at += len(text) + 1
    return out


def marked(text: str, start: int, end: int) -> bool:
    """Whether a window or the characters beside it hold a sign that isn't of sentences: what is open is marked as such."""
    return any(unicodedata.category(c)[0] in "PS" and c not in SENTENCE for c in text[max(0, start - 1) : end + 1])


def residue(text: str, found: list[tuple[str, int, int, float, float]]) -> list[tuple[str, int, int, float, float]]:
    """The windows that pass the thresholds of their kind over a normalised text; placeholders must be marked and not tiny."""
    own = [f for f in found if f[3] >= LEAST_SUM[f[0]] and f[4] >= LEAST_COVER[f[0]]]
    return [f for f in own if f[0] != "placeholder" or (f[2] - f[1] >= LEAST_LENGTH and marked(text, f[1], f[2]))]


_state: dict = {"models": None, "known": {}, "bytes": 0}


def judge(texts: list[str]) -> list[list[tuple[str, int, int, float, float]]]:
    """The residue of each text; equal texts are examined once per worker."""
    if _state["models"] is None:
        _state["models"] = load()
    if _state["bytes"] > MEMORY:
        _state["known"], _state["bytes"] = {}, 0
    known = dict.fromkeys(texts)
    known.update((t, _state["known"][t]) for t in known if t in _state["known"])
    new = [t for t, found in known.items() if found is None]
    _state["bytes"] += sum(4 * len(t) + 200 for t in new)
    start, size = 0, 0
    for k, t in enumerate(new):
        size += len(t)
        if size > 200_000 or k + 1 == len(new):
            own = new[start : k + 1]
            known.update(zip(own, map(residue, map(normal, own), examine(own, _state["models"]))))
            start, size = k + 1, 0
    _state["known"].update((t, known[t]) for t in new)
    return [known[t] for t in texts]


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = judge(pdf["text"].tolist())
        rows = [(i, f, n, *w) for i, f, n, own in zip(pdf["id"], pdf["field_name"], pdf["nth"], found) for w in own]
        yield pd.DataFrame(rows, columns=["id", "field_name", "nth", "kind", "start", "end", "score", "coverage"])


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """id, field_name, nth, kind, start, end, score, coverage of all residue of the evaluation items; items delivered twice give theirs twice."""
    items = spark.read.parquet(f"{folder}/multi_turn_set.parquet").where("id IS NOT NULL")
    one = items.select("id", F.lit("ground_truth").alias("field_name"), F.lit(0).alias("nth"), F.col("ground_truth").alias("text"))
    many = items.select("id", F.lit("expected_snippets").alias("field_name"), F.posexplode("expected_snippets").alias("nth", "text"))
    texts = one.unionByName(many).where("text IS NOT NULL AND text <> ''")
    return spread(texts).mapInPandas(_judged, "id string, field_name string, nth int, kind string, start int, end int, score double, coverage double")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return windows(spark, folder).select("id", "field_name").distinct()


def p3_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Where the residue stands, in the normalised texts."""
    return windows(spark, folder).select("id", "field_name", "nth", "kind", "start", "end", F.round("score", 3).alias("score"), F.round("coverage", 4).alias("coverage")).distinct()


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the items fit for evaluation: those without residue in either field."""
    items = spark.read.parquet(f"{folder}/multi_turn_set.parquet").where("id IS NOT NULL").select("id").distinct()
    return items.join(p3_found(spark, folder), "id", "left_anti")
