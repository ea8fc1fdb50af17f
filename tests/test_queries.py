import duckdb
import pytest

from seqtally.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", ["reads_fastq_multiline", "pool_add_status_none", "template_n_bases", "lookup_segmented", "match_best", "single_pe_best", "combo_se_3regions", "combo_pe_random_best_summary", "dual_pe_random_best", "random_se_best", "streaming_single_se", "lookup_exact_large", "single_se_large_pool", "dual_pe_reverse_best", "combo_pe_reverse_first", "dual_pe_ties_last", "single_se_ties_none", "dual_pe_diag_counts", "paired_fastq_files", "streaming_dual_pe", "streaming_single_dense", "streaming_random_se", "batch_handler", "dual_pe_shared_barcodes", "dual_pe_diag_tally", "lookup_iupac_wide", "lookup_remembered", "paired_fastq_strict", "reads_fastq_ranges_multiline", "handler_state_in_order", "handler_state_pairs", "streaming_fastq", "streaming_batches_dual_pe"])
def test_against_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert shown(df.select(*columns).collect()) == shown(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
