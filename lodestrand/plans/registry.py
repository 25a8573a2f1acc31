"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrand.operators import quantities, snapshots
from lodestrand.plans import catalogue

QUERIES: dict = {
    "p2_found": snapshots.p2_found,
    "p2_changes": snapshots.p2_changes,
    "p4_found": quantities.p4_found,
    "p4_amounts": quantities.p4_amounts,
} | catalogue.QUERIES
SQL: dict[str, str] = {"p2_found": snapshots.P2_FOUND_SQL, "p2_changes": snapshots.P2_CHANGES_SQL} | catalogue.SQL
