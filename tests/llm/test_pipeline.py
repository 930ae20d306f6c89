"""The registered queries next to their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from weft.llm.common import stored, table  # noqa: E402
from weft.llm.queries import ORACLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER)[0].startswith("ok"), name


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, FOLDER))
        assert out.columns == docs.columns and out.count() > 0
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids
        ids, docs = kept, out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len([r for r in packed if r["piece"] == 0]) == docs.count()
    assert {r["doc_id"] for r in packed} == ids
    again = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "ids_crc32", "length"]
    assert sorted(tuple(r) for r in again.select(*key).collect()) == sorted(tuple(r[k] for k in key) for r in packed)
