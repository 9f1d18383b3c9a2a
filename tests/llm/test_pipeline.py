import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "sentencepiece"]


def test_pipeline_on_edges(spark, edges, nothing, tmp_path):
    import corpus_pipeline as P
    for docs in (edges, nothing):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns
                out.write.parquet(str(tmp_path / f"{name}{docs is edges}{docs.count()}"))
            docs = out
        assert docs.filter("not round_trip").count() == 0


def test_pipeline_keeps_what_each_stage_alone_decides(spark):
    import corpus_pipeline as P
    from ledgerlens.llm import quality
    from ledgerlens.llm.common import read
    out = P.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    passing = {r.doc_id for r in quality.keep_passing(read(spark, SF, "documents")).select("doc_id").collect()}
    assert len(ids) == len(set(ids)) and set(ids) <= passing and len(ids) > 0.8 * len(passing)
    assert out.filter("not round_trip or n_tokens <> size(ids)").count() == 0


NAMES = ["op1_quality_rules", "op4_warc", "op7_ngram_jaccard_join", "op10_line_dedup",
         "op12_lexical_search", "op13_prefix_trie"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    from ledgerlens.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(SF, t)}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = sorted(con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall(), key=lambda r: tuple(map(str, r)))
    assert sorted(got, key=lambda r: tuple(map(str, r))) == want


def test_the_rest_queries_run(spark):
    from ledgerlens.llm.queries import QUERIES
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in sorted(set(QUERIES) - set(NAMES)):
        assert QUERIES[name](spark, SF).count() == n, name
