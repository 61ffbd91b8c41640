import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["period", "n_tx", "income", "spend", "net"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    """Where the subpackage or the pipeline can't be imported, the ledger's queries stay."""
    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = entry.queries()
    assert "monthly_flow" in found and "pipeline" not in found and not any(n.startswith("op1_") for n in found)
    assert set(entry.oracle_sql()) <= set(found)
