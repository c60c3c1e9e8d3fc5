"""The driver contract: every core query against its SQL over the whole small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from sheaf.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    import compare

    ok, text = compare.compare(spark, data, name, registry.queries()[name], registry.oracle_sql().get(name), compare.connect(data))
    assert ok, text


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sheaf")
    for d, _, names in os.walk(root):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "sheaf.llm" not in open(os.path.join(d, n), encoding="utf-8").read(), n
