"""All registered queries with their DuckDB equivalents."""

from __future__ import annotations

from . import diffs, documents, edits, lookups, midi, omr, profiles, scalars, scores

MODULES = (scalars, scores, midi, omr, lookups, profiles, diffs, edits, documents)
FLAGSHIP = "c15_playback_timeline"
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}
