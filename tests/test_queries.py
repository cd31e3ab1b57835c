"""Queries of the library against their SQL, on the smallest supplied tables."""

import datetime
import math
import os

import duckdb
import pytest

from quadrille.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# several queries share one function; the costlier ones are left to the driver's own comparison
NAMES = ["src_nq", "sink_block", "src_lookup", "part_hash", "flt_pattern", "flt_link", "fn_norm_url", "fn_pld", "fn_lang", "join_rank_ctx", "join_rewrite", "join_hash_rewrite", "join_selfpair", "srt_ext", "srt_check", "lim_pld", "set_reasoned_dupes", "set_diff_debug", "g_extract", "g_rewrite", "g_pagerank_na", "agg_rank_sum", "agg_predadj", "agg_econ_stats", "agg_spoc_stats", "sink_void", "agg_lang", "agg_crawl_log", "win_session_log", "cr_rounds", "c_closure", "c_card", "c_apply", "c_sim", "i_rules", "i_iig", "r_abox", "r_rules", "r_annot", "txt_query", "txt_pick", "qry_focus",
         "topk_conf", "topk_classes", "agg_incon_stats", "agg_incon_sets", "i_repair_delta", "c_extract", "c_dispatch", "c_fixpoint", "txt_build", "agg_rankdist", "agg_rank_max", "agg_cspo_stats", "agg_rdfvocab", "agg_patterncard", "g_pagerank", "join_semi_nodes", "flt_blacklist", "r_template"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_has_a_function():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
