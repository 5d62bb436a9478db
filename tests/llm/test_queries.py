"""Every registered operator query runs at the smallest scale, against its SQL where there is one."""

import os

import duckdb
import pandas as pd
import pytest

from mensura.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op5_bpe_encoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op9_order_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert set(COLUMNS.get(name, [])) <= set(got.columns)
    if name in COLUMNS:
        assert len(got) == len(pd.read_parquet(f"{SF}/{'pages' if 'page_id' in got else 'documents'}.parquet"))
    if name in queries.ORACLES:
        db = duckdb.connect()
        for f in os.listdir(SF):
            db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
        want = db.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
        assert plain(got) == plain(want)


@pytest.mark.parametrize("name,column,held_out,least", [("op6_language_id", "lang", True, 0.9), ("op7_quality_classifier", "quality", True, 0.9), ("op2_toxicity", "toxic", True, 0.9)])
def test_held_out_accuracy(spark, name, column, held_out, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    truth = pd.read_parquet(f"{sf}/{'documents' if column == 'lang' else 'labels'}.parquet")
    both = got[got.held_out].merge(truth[["doc_id", column]], on="doc_id")
    predicted = both.lang_pred if column == "lang" else both.predicted
    assert (predicted == both[column]).mean() >= least
