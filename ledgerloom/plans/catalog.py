"""Every query of the ledger library, gathered from the modules that register them."""

from __future__ import annotations

from importlib import import_module

from ledgerloom.plans.registry import ORACLES, QUERIES, Query

#: Modules whose import registers queries.
MODULES: tuple[str, ...] = ("cashflow", "browse", "quality", "networth", "transfers", "imports", "statements", "layouts", "rules", "maintain", "accounts", "review", "audit", "rebuild", "alignment", "split", "deletion", "persist", "scalars")
STREAMS: tuple[str, ...] = ("ingest", "redetect")


def _load() -> None:
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
    for name in STREAMS:
        import_module(f"ledgerloom.streaming.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
