"""Training of the tagger: python -m lodestrand.llm.pii_train DOCUMENTS [OUT]

The sample is bounded: at most SAMPLE_DOCS documents, of which every window with a labelled span and
at most SAMPLE_PLAIN without one are used; of the distinct clauses, those with a span and SHORT without
are examples of short texts. Beside them stand MADE texts of `pii_examples`, whose wordings and values
aren't the sample's. One document in ten is held out. Training goes on from the stored weights, if there
are any of this size.
"""

from __future__ import annotations

import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the workers share the cores already; set before numpy is loaded
import re
import sys
import time
from bisect import bisect_left

import numpy as np
import pandas as pd

from lodestrand.llm import pii, pii_examples, pii_labels
from lodestrand.llm.tagger import Tagger, fit, tags_of

SAMPLE_DOCS, SAMPLE_PLAIN, SHORT, SWAPS = 10_000, 60_000, 12_000, 4
DAMAGED, MADE = 6_000, 40_000
#: Windows of examples, and the tagger's size.
TRAINED, WIDTH, HIDDEN = 128, 20, 24
LEAST_SEEN = 2
#: Of the swapped values so many go over a line end.
WRAPPED = 0.15
EPOCHS, BATCH, WORKERS = (2, 4), 256, 8

# Clause ends, where labels are looked up and short texts are cut.
BREAK = re.compile(r"[。！？；，]+|; |, (?=[a-zäöü])|\n+|\t|(?<=[^\s.]{3}[.!?])(?<!Mrs\.)(?<!gez\.) +(?=[A-ZÄÖÜ])|(?m:^(?:[A-Z][a-z]{3,8}: |[一-鿿]{2}：))")


def segments(shaped: str) -> list[tuple[int, int]]:
    out, start = [], 0
    for m in BREAK.finditer(shaped):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(shaped):
        out.append((start, len(shaped)))
    return out


def examples(texts: list[str]) -> tuple[dict[str, list], dict[str, int]]:
    """Distinct segments with their labelled spans, and how often each occurs; a segment labelled once is labelled everywhere."""
    out: dict[str, list] = {}
    times: dict[str, int] = {}
    for text in texts:
        labels, shaped = pii_labels.spans(pii.plain(text)), pii.shape(text)
        for a, b in segments(shaped):
            back, key = pii.places(shaped[a:b]), pii.shorten(shaped[a:b])
            times[key] = times.get(key, 0) + 1
            own = [(bisect_left(back, max(s, a) - a), bisect_left(back, min(e, b) - a), kind) for s, e, kind in labels if s < b and e > a]
            if own or key not in out:
                out[key] = own
    return out, times


def labelled(text: str, known: dict[str, list]) -> tuple[str, list]:
    """The whole text as the tagger reads it, with the spans of its segments."""
    shaped = pii.shape(text)
    back, out = pii.places(shaped), []
    for a, b in segments(shaped):
        if own := known.get(pii.shorten(shaped[a:b])):
            at = pii.places(shaped[a:b])
            out += [(bisect_left(back, a + at[s]), bisect_left(back, a + at[e]), kind) for s, e, kind in own]
    return pii.shorten(shaped), out


def wrapped(value: str, kind: str, r: np.random.Generator) -> str:
    """The value, now and then with a line end in it."""
    at = [m.start() for m in re.finditer(" ", value)]
    if kind == "email" or r.random() >= WRAPPED or not (at or (len(value) > 7 and kind == "address")):
        return value
    k = int(r.choice(at)) if at else int(r.integers(2, len(value) - 2))
    return value[:k] + "\n" + value[k + bool(at) :]


def shouted(part: str, spans: list) -> str:
    """The segment with its spans in capitals, as forms and signatures often have them."""
    for a, b, kind in spans:
        upper = part[a:b].upper()
        if kind in ("name", "email", "address") and len(upper) == b - a:
            part = part[:a] + upper + part[b:]
    return part


def swapped(part: str, spans: list, pool: dict, r: np.random.Generator) -> tuple[str, list]:
    """The segment with other values of the same kinds and scripts in its spans."""
    out, new, at = "", [], 0
    for a, b, kind in sorted(spans):
        values = pool[kind, part[a:b].isascii()]
        value = wrapped(values[r.integers(len(values))], kind, r)
        out += part[at:a]
        new.append((len(out), len(out) + len(value), kind))
        out += value
        at = b
    return out + part[at:], new


def windows_of(part: str, spans: list, start: int = 0) -> list[tuple[str, np.ndarray]]:
    tags = tags_of(len(part), spans)
    return [(part[start + a : start + b], tags[start + a : start + b]) for a, b in pii.windows(len(part) - start, TRAINED)]


def as_read(text: str, spans: list) -> tuple[str, list]:
    """A text as the tagger reads it, with its spans."""
    shaped = pii.shape(pii.plain(text))
    back = pii.places(shaped)
    return pii.shorten(shaped), [(bisect_left(back, a), bisect_left(back, b), kind) for a, b, kind in spans]


def main(source: str, out: str = pii.MODEL) -> None:
    texts = pd.read_parquet(source, columns=["text"])["text"].dropna().tolist()[:SAMPLE_DOCS]
    known, times = examples(texts)
    train, held = [labelled(t, known) for k, t in enumerate(texts) if k % 10], [labelled(t, known) for t in texts[::10]]
    short, _ = examples([t for k, t in enumerate(texts) if k % 10])
    r = np.random.default_rng(3)
    pool: dict = {}
    for k, v in train:
        for a, b, kind in v:
            pool.setdefault((kind, k[a:b].isascii()), []).append(k[a:b])
    holding = [(k, v) for k, v in train if v]
    some = [(k, v) for k, v in short.items() if v]
    copies = [swapped(k, v, pool, r) for k, v in holding for _ in range(SWAPS)] + [(shouted(k, v), v) for k, v in holding + [swapped(k, v, pool, r) for k, v in holding]]
    own = [w for k, v in train for w in windows_of(k, v)]
    with_spans = [w for w in own if w[1].any()]
    with_spans += [w for k, v in copies for w in windows_of(k, v, int(r.integers(0, min(80, len(k) - 1)))) if w[1].any()]
    with_spans += [w for k, v in some + [swapped(k, v, pool, r) for k, v in some for _ in range(2)] for w in windows_of(k, v)]
    without = [w for w in own if not w[1].any()]
    without = [without[k] for k in r.permutation(len(without))[:SAMPLE_PLAIN]]
    plain = [k for k, v in short.items() if not v]
    plain = sorted((plain[k] for k in r.permutation(len(plain))), key=lambda k: -times[k])[:SHORT]
    damaged = [(w[0].upper(), w[1]) for k in r.integers(0, len(without), DAMAGED) for w in (without[k],) if len(w[0].upper()) == len(w[0])]
    spare = [w for k in plain for w in windows_of(k, [])] + damaged
    bare = [pii.plain(t)[a:b].strip() for k, t in enumerate(texts[:3000]) if k % 10 for a, b in segments(pii.plain(t))]
    bare = [t for t in dict.fromkeys(bare) if 12 < len(t) < 90 and not pii_labels.spans(t) and not known.get(pii.shorten(pii.shape(t)))][:20_000]
    extra = [as_read(*x) for x in pii_examples.made(MADE, r, bare)]
    made = [w for k, v in extra for w in windows_of(k, v)]
    seen: dict[str, int] = {}
    for k in [*short, *(k for k, _ in extra)]:
        for c in set(k):
            seen[c] = seen.get(c, 0) + 1
    alphabet = "".join(sorted(c for c, n in seen.items() if n >= LEAST_SEEN))
    tagger = Tagger.load(pii.MODEL).widened(alphabet) if os.path.exists(pii.MODEL) else None
    if tagger is None or tagger.w["fU"].shape[0] != HIDDEN:
        tagger = Tagger.new(alphabet, WIDTH, HIDDEN)
    began = time.time()
    print(len(with_spans), "windows with spans,", len(without) + len(spare), "without,", len(made), "made,", len(tagger.alphabet), "characters", flush=True)
    say = lambda s: print(s, round(time.time() - began), "s", flush=True)
    fit(tagger, with_spans + without[: SAMPLE_PLAIN // 2] + spare + made, EPOCHS[0], BATCH, say=say, workers=WORKERS)
    # what it takes for personal data wrongly, or misses, comes again more often
    wrong = [w for w, spans in zip(own, tagger.decode([k for k, _ in own])) if (tags_of(len(w[0]), spans) != w[1]).any()]
    print(len(wrong), "windows of the sample wrong", flush=True)
    fit(tagger, with_spans * 2 + without[SAMPLE_PLAIN // 2 :] + spare + made + wrong * 5, EPOCHS[1], BATCH, rate=2e-3, say=say, workers=WORKERS)
    tagger.save(out)
    tagger = Tagger.load(out)
    got = pii.decode([k for k, _ in held], tagger)
    said = {(k, *s) for k, spans in enumerate(got) for s in spans}
    true = {(k, *s) for k, (_, v) in enumerate(held) for s in v}
    print(f"held out: {len(true)} spans, precision {len(said & true) / max(1, len(said)):.4f}, recall {len(said & true) / max(1, len(true)):.4f}")
    for k, a, b, kind in sorted(said ^ true)[:40]:
        print("+" if (k, a, b, kind) in said else "-", kind, repr(held[k][0][max(0, a - 20) : b + 20]))


if __name__ == "__main__":
    main(*sys.argv[1:])
