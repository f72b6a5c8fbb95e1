import importlib
import sys


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"w1_topk", "w8_filtered_multi_join", "p4_found", "p5_found"} <= set(q)


def test_core_stands_without_the_extra_package(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("quillon.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert "p5_found" in e.queries() and "p1_found" not in e.queries()
    monkeypatch.undo()
