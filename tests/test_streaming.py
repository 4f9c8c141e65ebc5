"""The current assembly per species in stream state: late and repeated files, restarts, hot species."""

import json

import pytest

from baseloom.operators.catalog import current_assemblies
from baseloom.session import scratch_path
from baseloom.streaming import current as CU


def record(accession, organism):
    return json.dumps({"accession": accession, "organism": {"organism_name": organism, "tax_id": 7}, "assembly_info": {"assembly_level": ""}})


def put(spark, folder, *rows):
    spark.createDataFrame([(record(*r),) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)


@pytest.fixture
def places(spark):
    return scratch_path(spark, "t-drops"), scratch_path(spark, "t-store")


def catalog(spark, store):
    return {r.accession: (r.species_key, r.is_current_for_species, r.replaced_by_accession) for r in CU.current_catalog(spark, store).collect()}


def events(spark, store):
    return sorted(tuple(r) for r in CU.supersessions(spark, store).collect())


def test_before_any_file(spark, places):
    _, store = places
    assert catalog(spark, store) == {} and events(spark, store) == []


def test_late_repeated_and_blank(spark, places):
    folder, store = places
    put(spark, folder, ("GCA_2.1", "Aa bb"), ("GCA_9.2", None), ("", "Aa bb"), (None, "Aa bb"))
    CU.run_once(spark, folder, store)
    assert catalog(spark, store) == {"GCA_2.1": ("Aa_bb", True, ""), "GCA_9.2": ("GCA_9", True, "")}
    # A late lower accession changes nothing; a RefSeq one takes over.
    put(spark, folder, ("GCA_1.1", "Aa bb"), ("GCA_2.1", "Aa bb"))
    CU.run_once(spark, folder, store)
    assert events(spark, store) == []
    put(spark, folder, ("GCF_1.1", "Aa  bb"), ("GCA_9.1", ""))
    CU.run_once(spark, folder, store)
    put(spark, folder, ("GCF_1.1", "Aa bb"), ("GCA_3.1", "Aa bb"))
    CU.run_once(spark, folder, store)
    assert events(spark, store) == [(2, "Aa_bb", "GCA_2.1", "GCF_1.1", 2)]
    found = catalog(spark, store)
    assert found["GCF_1.1"][1:] == (True, "") and found["GCA_3.1"][1:] == (False, "GCF_1.1")
    assert found["GCA_9.1"] == ("GCA_9", False, "GCA_9.2")
    # Without new files nothing happens.
    CU.run_once(spark, folder, store)
    assert catalog(spark, store) == found and len(events(spark, store)) == 1


def test_a_batch_that_runs_again(spark, places):
    """The rows were taken but the log was not written: the next run logs them once."""
    folder, store = places
    put(spark, folder, ("GCA_1.1", "Aa bb"))
    CU.collect_rows(spark, folder, f"{store}/rows", f"{store}/rows-progress").awaitTermination()
    put(spark, folder, ("GCA_4.1", "Aa bb"), ("GCA_5.1", "Cc dd"))
    CU.run_once(spark, folder, store)
    assert {a for a, r in catalog(spark, store).items() if r[1]} == {"GCA_4.1", "GCA_5.1"}
    assert CU.read_rows(spark, store).count() == 3


def test_equal_to_the_batch_operator(spark, places):
    """A species with a third of all rows, in three drops, against the operator on the union."""
    folder, store = places
    rows = [(f"{'GCF' if i % 7 == 3 else 'GCA'}_{(i * 37) % 500:03d}.{i % 3}", f"Hot one{'' if i % 3 == 0 else i % 11}") for i in range(500)]
    rows = list({r[0]: r for r in rows}.values())
    for part in (rows[::2], rows[1::3] + rows[:50], rows):
        put(spark, folder, *part)
        CU.run_once(spark, folder, store)
    union = CU.assembly_rows(spark.read.schema("accession string, organism struct<organism_name: string, tax_id: bigint>, assembly_info struct<assembly_name: string, assembly_level: string, refseq_category: string>").json(folder)).distinct()
    wanted = {r.accession: (r.species_key, r.is_current_for_species, r.replaced_by_accession) for r in current_assemblies(union).collect()}
    assert catalog(spark, store) == wanted and len(wanted) == len(rows)
    assert {e[3] for e in events(spark, store)} <= {r[0] for r in rows} and events(spark, store)
