"""All registered queries outside the llm subpackage, and their SQL twins."""

from __future__ import annotations

from dayweave.plans import annotation, behaviour, behaviour_sql, claims, corpus, evaluation, observations, reports, sources, streams

QUERIES = behaviour.QUERIES | claims.QUERIES | evaluation.QUERIES | observations.QUERIES | annotation.QUERIES | corpus.QUERIES | reports.QUERIES | streams.QUERIES | sources.QUERIES
ORACLES = behaviour_sql.ORACLES | claims.ORACLES | evaluation.ORACLES | observations.ORACLES | annotation.ORACLES | corpus.ORACLES | reports.ORACLES | streams.ORACLES | sources.ORACLES
