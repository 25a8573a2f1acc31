"""Amounts stated in many units, brought to common units and held against what is stored.

Parsing is by `lodestrand.functions.units`; it runs in Arrow batches over narrow columns and keeps
a bounded memory of texts seen, as the same phrases recur. There is no shuffle but the one of the
short results, which drops rows delivered twice.

Defined results: null and empty texts state no amount. Equal rows of an id count once; an id is
wrong if one of its rows is. Rows without an id are ignored. Texts of any length are read whole; text without a known unit states nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestrand.functions.units import amounts, german, near, same_amounts, stored
from lodestrand.session import spread, table

COMMON = "tab string, id long, said string, kept string, wrong boolean"


def text_of(found: tuple) -> str:
    """Amounts as they are stored: 24month|8000km, sorted, each once."""
    return "|".join(sorted({f"{n:g}{u}" for n, u in found}))


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, value, kept, *words in zip(pdf["id"], pdf["value"], pdf["value_normalized"], pdf["predicate"], pdf["subject"], pdf["section"], pdf["qualifiers"]):
            value = value or ""
            said = amounts(value, german(value, *words)) if any(map(str.isnumeric, value)) or "年" in value or "ear" in value.lower() or "ahr" in value.lower() else ()
            rows.append(("claim", key, text_of(said), kept, bool(said) and not (kept is not None and same_amounts(said, stored(kept)))))
        yield pd.DataFrame(rows, columns=["tab", "id", "said", "kept", "wrong"])


def _maintenance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, value, km, item, note in zip(pdf["id"], pdf["period_text"], pdf["period_km"], pdf["item"], pdf["note"]):
            value = value or ""
            said = amounts(value, german(value, item, note))
            distance = next((a for a in said if a[1] == "km"), None)
            kept = None if km is None or km != km else int(km)
            rows.append(("maintenance", key, text_of(said), None if kept is None else f"{kept}km", distance is not None and not (kept and near(distance, (float(kept), "km")))))
        yield pd.DataFrame(rows, columns=["tab", "id", "said", "kept", "wrong"])


def compared(spark: SparkSession, folder: str) -> DataFrame:
    """tab, id, said (all amounts of the text in common units), kept (the stored field), wrong; rows delivered twice are there twice."""
    claim = table(spark, folder, "claim").where("id IS NOT NULL").select("id", "value", "value_normalized", "predicate", "subject", "section", "qualifiers")
    maintenance = table(spark, folder, "maintenance").where("id IS NOT NULL").select("id", "period_text", "period_km", "item", "note")
    return spread(claim).mapInPandas(_claims, COMMON).unionByName(spread(maintenance).mapInPandas(_maintenance, COMMON))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return compared(spark, folder).where("wrong").select("tab", "id").distinct()


def p4_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose text states amounts, with these in common units."""
    return compared(spark, folder).where("said <> ''").distinct()
