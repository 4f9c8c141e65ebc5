"""Summary files that arrive in three drops, some late and some twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.session import scratch_path
from baseloom.streaming import current as CU
from workload import inputs as I
from workload.catalog_queries import _CURRENT
from workload.registry import query


def _streamed(spark, d) -> str:
    """Runs both streams after each drop and gives the store; higher accessions need not come later."""
    folder, store = scratch_path(spark, "drops"), scratch_path(spark, "current")
    named = F.when(F.col("species_key") != "", F.col("organism_name"))
    record = F.to_json(
        F.struct(
            "accession",
            F.struct(named.alias("organism_name"), F.col("row_idx").alias("tax_id")).alias("organism"),
            F.struct(F.lit("").alias("assembly_name"), "assembly_level").alias("assembly_info"),
        )
    )
    rows = I.assemblies(spark, d).select(record.alias("value"), "row_idx")
    number = "floor(row_idx / 8) % 3"
    for drop in (f"{number} = 0", f"{number} = 1 OR {number} = 0 AND row_idx % 2 = 0", f"{number} = 2 OR row_idx % 5 = 0"):
        rows.where(drop).select("value").write.mode("append").text(folder)
        CU.run_once(spark, folder, store)
    return store


@query("st01_current_stream", f"WITH {I.ASM_SQL}, {_CURRENT} SELECT accession, species_key, is_current_for_species, replaced_by_accession FROM cur")
def current_stream(spark, d):
    return CU.current_catalog(spark, _streamed(spark, d)).select("accession", "species_key", "is_current_for_species", "replaced_by_accession")


@query(
    "st01_supersession_stream",
    f"""WITH {I.ASM_SQL}, {_CURRENT}, drops AS (SELECT b.batch, c.species_key, c.accession, c.drop_no FROM (SELECT cur.*, (row_idx // 8) % 3 AS drop_no FROM cur JOIN assemblies USING (accession)) c
    JOIN (SELECT unnest([0, 1, 2]) AS batch) b ON c.drop_no <= b.batch),
  best AS (SELECT batch, species_key, first(accession ORDER BY CASE WHEN accession LIKE 'GCF%' THEN 0 ELSE 1 END, accession DESC) AS accession, count(*) AS n FROM drops GROUP BY ALL)
  SELECT CAST(n.batch AS BIGINT) AS batch, n.species_key, o.accession AS old_accession, n.accession AS new_accession, n.n - 1 AS n_superseded
  FROM best n JOIN best o ON o.species_key = n.species_key AND o.batch = n.batch - 1 AND o.accession <> n.accession""",
)
def supersession_stream(spark, d):
    return CU.supersessions(spark, _streamed(spark, d))
