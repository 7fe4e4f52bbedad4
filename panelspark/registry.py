"""All queries over the supplied tables, with SQL for those that SQL can express."""

from __future__ import annotations

from panelspark.plans import accounts, catalog, datasets, evaluation, fold_audit, learning, membership, research, sampled, snapshots, stored

FLAGSHIP = "w7_w13_market_signals"


def queries() -> dict:
    return {**catalog.QUERIES, **evaluation.QUERIES, **datasets.QUERIES, **research.QUERIES, **learning.QUERIES, **sampled.QUERIES, **stored.QUERIES, **membership.QUERIES, **accounts.QUERIES, **fold_audit.QUERIES, **snapshots.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog.SQL, **evaluation.SQL, **datasets.SQL, **research.SQL, **learning.SQL, **sampled.SQL, **stored.SQL, **membership.SQL, **accounts.SQL, **fold_audit.SQL, **snapshots.SQL}
