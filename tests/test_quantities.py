from lodestrand.operators import quantities
from tests.conftest import rows

CLAIM = "id long, value string, value_normalized string, predicate string, subject string, section string, qualifiers string, wrong boolean, said string"
MAINTENANCE = "id long, period_text string, period_km int, item string, note string"


def test_rows_whose_amount_is_wrong(tables, spark):
    folder = tables(
        claim=(CLAIM, [
            (1, "2.1 bar", "210kpa", "limit", None, None, None, True, "x"), (2, "2.1 bar", "2bar", None, None, None, None, None, None), (3, "2,5 bar", "250kpa", "Sollwert", None, None, "[", None, None),
            (4, "1,200 Nm", "1.2nm", "nominal torque", None, None, None, None, None), (5, "5W-40", None, None, None, None, None, None, None), (6, None, "3l", None, None, None, None, None, None), (7, "3 L", None, None, None, None, None, None, None),
            (7, "3 L", None, None, None, None, None, None, None), (8, "", "", None, None, None, None, None, None), (9, "3 L " * 50_000, "3l", None, None, None, None, None, None),
        ]),
        maintenance=(MAINTENANCE, [
            (1, "每7,500km", 7500, None, None), (2, "100.000 km", 100000, "spülen", None), (3, "100.000 km", 100000, "flush", None), (4, "every 3 years", 0, None, None),
            (5, "28,000 mi", 45000, None, None), (6, "28,000 mi", 28000, None, None), (7, "8000 km", None, None, None), (7, "8000 km", None, None, None), (8, None, None, None, None),
        ]),
    )
    assert rows(quantities.p4_found(spark, folder)) == [("claim", 2), ("claim", 4), ("claim", 7), ("maintenance", 3), ("maintenance", 6), ("maintenance", 7)]
    assert {r["id"]: r["said"] for r in quantities.p4_amounts(spark, folder).where("tab = 'claim'").collect()}[1] == "210kpa"


def test_empty_tables(tables, spark):
    folder = tables(claim=(CLAIM, []), maintenance=(MAINTENANCE, []))
    assert rows(quantities.p4_found(spark, folder)) == []
