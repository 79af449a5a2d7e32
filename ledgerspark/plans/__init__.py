"""All queries of the ledger engine."""


def queries():
    from . import edits, entry, ingest, matching, more, registry, reports, scalars  # noqa: F401  they register themselves
    return dict(registry.QUERIES)


def oracle_sql():
    queries()
    from . import registry
    return dict(registry.SQL)
