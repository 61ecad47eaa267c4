"""Name -> query and SQL of every operator outside the corpus-preparation subpackage."""

from __future__ import annotations

FLAGSHIP = "chunk_eligibility_by_source"


def _catalogs():
    from millrace.plans import aggregates, bank, booklets, curation, detail, exams, items, joins, layout, likeness, more, passes, planning, portal, records, roles, rules, sites, states, syllabus, web

    return [m.catalog for m in (joins, aggregates, curation, web, states, items, more, roles, rules, exams, sites, syllabus, booklets, likeness, planning, layout, portal, detail, records, passes, bank)]


def queries() -> dict:
    return {name: f for c in _catalogs() for name, f in c.queries.items()}


def oracles() -> dict:
    return {name: sql for c in _catalogs() for name, sql in c.sql.items()}
