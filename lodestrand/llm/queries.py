"""The subpackage's queries and their SQL, as added by __spark_entry__.py."""

from __future__ import annotations

from lodestrand.llm import leaks, mixing, near_duplicates, pii, residue, splitting

QUERIES = {
    "p1_found": near_duplicates.p1_found,
    "p1_groups": near_duplicates.p1_groups,
    "p3_found": residue.p3_found,
    "p3_windows": residue.p3_windows,
    "p3_kept": residue.p3_kept,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p6_found": leaks.p6_found,
    "p6_report": leaks.p6_report,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p8_found": pii.p8_found,
    "p8_redacted": pii.p8_redacted,
}

SQL: dict[str, str] = {
    "p1_found": near_duplicates.P1_FOUND_SQL,
    "p1_groups": near_duplicates.P1_GROUPS_SQL,
    "p5_found": splitting.P5_FOUND_SQL,
    "p6_found": leaks.P6_FOUND_SQL,
}
