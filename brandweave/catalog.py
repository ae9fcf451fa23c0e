"""Names the registered queries outside the corpus operators, with their oracles."""

from __future__ import annotations

from brandweave.plans import events, sales, text, vectors

QUERIES: dict = {**sales.QUERIES, **text.QUERIES, **vectors.QUERIES, **events.QUERIES}
ORACLES: dict[str, str] = {**sales.ORACLES, **text.ORACLES, **vectors.ORACLES, **events.ORACLES}
