"""Every registered query of the library, with its oracle SQL where SQL can state it."""

from __future__ import annotations

from pairlens.plans import cards, checking, designs, logs, paired, scoring, selecting, streams, texts

MODULES = [paired, selecting, logs, texts, designs, checking, streams, scoring, cards]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
