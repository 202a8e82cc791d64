import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    got = E.entry(spark)
    assert got.columns == ["doc_id", "class", "p", "rank"] and got.count() > 0


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(E.__file__), "epiquery")
    for d, _, files in os.walk(root):
        if os.path.basename(d) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(from|import) .*\bllm\b", open(os.path.join(d, f)).read(), re.M), f
