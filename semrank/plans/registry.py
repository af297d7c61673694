"""All registered queries of the engine."""

from __future__ import annotations

from semrank.plans import adapters, base, evaluate, ingest, items, judging, rank, reader, store, streams, text  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)
