import pytest
from conftest import same_rows

from sparkloom import catalogue, catalogue_more, catalogue_store  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLES[name])


def test_chunk_ids_are_repeatable(spark, sf):
    once, twice = (catalogue.chunk_documents(spark, sf) for _ in range(2))
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_every_chunk_is_linked(spark, sf):
    store = catalogue.knowledge(spark, sf)
    assert store.chunks.select("id", "language").exceptAll(store.links.select("chunk_id", "node_id")).isEmpty()
