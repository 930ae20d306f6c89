"""Registered queries next to their SQL at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracle import TABLES, compare  # noqa: E402
from weft.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["theme_saturation", "study_coverage", "translation_stats", "entropy_curve", "chao1", "rarefaction", "reflexivity",
           "tfidf_top_terms", "cosine_pairs", "ppmi", "bigram_perplexity", "betweenness_centrality", "hasse_edges", "zeta_values",
           "formal_concepts", "implications", "sentence_sentiment", "unit_themes", "argument_relations", "causal_edges",
           "feedback_loops", "fuzzy_similarity", "ndcg_by_membership", "auc", "depth_index", "influence_degree", "co_evolution",
           "code_cooccurrence", "syntheses", "traditions", "incommensurability", "wl_kernel", "split_gain"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER)[0].startswith("ok"), name


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
