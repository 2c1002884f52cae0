"""Registered queries: SQL equivalents, columns, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from tarnflow.llm import queries as q

from ..test_oracle import TABLES, value
from .helpers import awkward, empty


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = q.QUERIES[name](spark, sf_dir)
    found = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(got.columns)
    assert order == sorted(names)
    a = sorted([value(r[c]) for c in order] for r in got.collect())
    b = sorted([value(r[names.index(c)]) for c in order] for r in found.fetchall())
    assert a == b


def test_pipeline_runs_and_stages_keep_columns(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 1024).all() and len(out) > 50
    assert len(corpus_pipeline.STAGES) == 5
    for table in (awkward(spark), empty(spark)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < 4:
                assert docs.columns == table.columns
        docs.count()
