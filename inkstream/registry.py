"""Every query of the narration operators, with its SQL where SQL can express it."""

from __future__ import annotations

from inkstream.plans import decisions, glossary, live, manuscripts, merging, pickups, signals, texts

PLANS = (manuscripts, texts, glossary, pickups, decisions, merging, signals, live)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
