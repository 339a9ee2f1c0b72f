"""Every query against its SQL twin, over the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import difference
from plumbline.plans import catalog, oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")


def test_every_query_has_a_twin():
    assert catalog.CATALOG.keys() == oracle.all_sql().keys()
    assert contract.queries().keys() >= contract.oracle_sql().keys() >= catalog.CATALOG.keys()


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query(spark, name):
    assert difference(spark, FOLDER, name) is None


def test_degrees_of_a_category_are_counted_once(spark, monkeypatch):
    staged = []
    keep = catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name: staged.append(name) or keep(df, name))
    monkeypatch.setattr(catalog, "_scored", lambda *x: pytest.fail("edges were joined with degrees that nobody reads"))
    vertices, edges = catalog._by_category(catalog._reviews(spark, FOLDER))
    assert len(vertices) == len(edges) == len(catalog.CATEGORIES)
    assert staged.count("degrees") == len(catalog.CATEGORIES)
