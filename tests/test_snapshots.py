import datetime as dt
import random

import numpy as np
import pytest

from lodestrand.functions.unicode import squeeze_value
from lodestrand.operators import snapshots
from tests.conftest import rows

VERSION = "id long, doc_source string, extracted_at timestamp_ntz, run string, bucket int"
CLAIM = "id long, version_id long, claim_key string, value string, g long, key string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(versions, claims):
    """Changes by dictionaries, the plain way."""
    versions = {v[0]: v for v in versions if v[0] is not None and v[1] is not None}
    full = {}
    for c in sorted({c[:4] for c in claims if None not in c[:3]}, key=lambda c: c[0]):
        full.setdefault(c[1], {})[c[2]] = c[3]
    by = {}
    for v in sorted((v for k, v in versions.items() if k in full), key=lambda v: (v[2] is not None, v[2] or day(0), v[0])):
        by.setdefault(v[1], []).append(v[0])
    out = set()
    for ids in by.values():
        for a, b in zip(ids, ids[1:]):
            for k in full[a].keys() | full[b].keys():
                kind = "added" if k not in full[a] else "removed" if k not in full[b] else "changed" if squeeze_value(full[a][k]) != squeeze_value(full[b][k]) else None
                if kind:
                    out.add((b, k, kind))
    return sorted(out)


def test_against_brute_force(tables, spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", 3)
    r = random.Random(4)
    versions, claims, n = [], [], 0
    for v in range(40):
        versions.append((v, r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([day(r.randrange(20)), None]), "x", 1))
        for k in r.sample(range(8), r.randrange(0, 8)):
            for _ in range(r.choice([1, 1, 2])):
                n += 1
                claims.append((n, r.choice([v, v, v, v - 1]), r.choice([f"k{k}", f"k{k}", None]), r.choice(["5,000 km", "５０００KM", "6 km", None, ""]), 0, "z"))
    claims += claims[:20] + [(9001, 777, "k1", "v", 0, "z"), (9002, None, "k1", "v", 0, "z")]
    folder = tables(doc_version=(VERSION, versions + versions[:5]), claim=(CLAIM, claims))
    assert rows(snapshots.p2_found(spark, folder)) == brute(versions, claims)


def test_values_come_with_changes(tables, spark):
    folder = tables(doc_version=(VERSION, [(1, "a", day(1), None, None), (2, "a", day(2), None, None)]), claim=(CLAIM, [(1, 1, "k", "old", 0, ""), (2, 2, "k", "new", 0, ""), (3, 1, "gone", "x", 0, ""), (4, 2, "come", None, 0, "")]))
    assert rows(snapshots.p2_changes(spark, folder).na.fill("-")) == [(2, "come", "added", "-", "-"), (2, "gone", "removed", "x", "-"), (2, "k", "changed", "old", "new")]


def test_empty_tables(tables, spark):
    folder = tables(doc_version=(VERSION, []), claim=(CLAIM, []))
    assert rows(snapshots.p2_found(spark, folder)) == []


@pytest.mark.parametrize("seed", range(5))
def test_differences_of_blocks(seed):
    """Any run of deliveries gives its part of the changes of the whole."""
    r = np.random.default_rng(seed)
    pairs = sorted({(int(k), int(g)) for k, g in r.integers(0, 12, (60, 2))})
    key, g = np.array(pairs).T
    value, row = r.integers(0, 3, len(key)), np.arange(len(key))
    first, last = g == 0, g == 11
    whole = snapshots.differences(key // 2, key % 2, g, value % 2, value // 2, row, first, last, 0, 12)
    parts = []
    for low in range(0, 12, 4):
        own = (g >= low - 1) & (g < low + 4)
        parts += snapshots.differences(key[own] // 2, key[own] % 2, g[own], value[own] % 2, value[own] // 2, row[own], first[own], last[own], low, low + 4).itertuples(index=False)
    assert sorted(map(tuple, parts)) == sorted(map(tuple, whole.itertuples(index=False)))
