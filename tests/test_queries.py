"""Every query with SQL gives the rows of its SQL, on all tables."""

import pytest

from lodestone.plans import registry
from tests.oracle import compare

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    ok, said = compare(spark, registry.queries()[name], registry.oracle_sql()[name], DIR)
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "id", "similarity", "rank"]
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_documents_come_back_from_their_chunks(spark):
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r["content"] for r in registry.queries()["documents_from_chunks"](spark, DIR).collect()}
    assert max(map(len, got.values())) > 4000 and got == {d: t for d, t in texts.items() if t}


def test_seeds_first_names_all_that_seeds_touch(spark):
    """No cut: every nation with a 1 in its name, its region, customers and suppliers, places without a gap."""
    own = spark.read.parquet(f"{DIR}/nation.parquet").where("n_name LIKE '%1%'").select("n_nationkey", "n_regionkey").collect()
    nations = {r[0] for r in own}
    wanted = {f"N:{n}" for n in nations} | {f"R:{r[1]}" for r in own}
    for t, p in (("customer", "c"), ("supplier", "s")):
        wanted |= {f"{p.upper()}:{r[0]}" for r in spark.read.parquet(f"{DIR}/{t}.parquet").select(f"{p}_{'cust' if p == 'c' else 'supp'}key", f"{p}_nationkey").collect() if r[1] in nations}
    got = registry.queries()["seeds_first"](spark, DIR).orderBy("place").collect()
    assert len(got) > 50 and {r["id"] for r in got} == wanted and [r["place"] for r in got] == list(range(1, len(got) + 1))
    assert [r["id"] for r in got] == sorted(wanted, key=lambda x: (x not in {f"N:{n}" for n in nations}, x))
