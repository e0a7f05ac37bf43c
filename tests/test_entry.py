import importlib
import os
import sys

import pytest

SMALL = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p5_found" in e.queries()


def test_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "sheafline.llm", None)
    import __spark_entry__ as e

    try:
        again = importlib.reload(e)
        assert "search_topk" in again.queries() and not any(q.startswith("p1") for q in again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "sheafline")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "sheafline.llm" not in f.read(), n


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert 0 < len(rows) <= 8 and rows == sorted(rows, key=lambda r: -r["score"])
