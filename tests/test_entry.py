"""The entry points, with and without the training-data subpackage."""

import importlib

import __spark_entry__


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["cell_barcode", "Haplotype_1_Sum", "Haplotype_2_Sum", "active_X"] and out.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_llm", lambda: None)
    names = __spark_entry__.queries()
    assert "active_x" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert importlib.import_module("barrspark.plans.queries").QUERIES.keys() == names.keys()
