import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weft.session import local_session  # noqa: E402
from weft.sources.documents import Evidence  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "weft-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Evidence from {theme: [study ids]} and optional study / theme details."""

    def build(assigned, studies, years=None, texts=None, labels=None, levels=None, parents=None, concepts=None):
        rows = [(s, i, (years or {}).get(s, 2000 + i), "moderate", (texts or {}).get(s, [])) for i, s in enumerate(studies)]
        st = spark.createDataFrame(rows, "study_id string, ord bigint, year int, quality_score string, findings array<string>")
        names = [(t, i, (labels or {}).get(t, t), "", (levels or {}).get(t, "descriptive"), (parents or {}).get(t),
                  (concepts or {}).get(t, [])) for i, t in enumerate(assigned)]
        th = spark.createDataFrame(names, "theme_id string, ord bigint, label string, description string, level string, "
                                          "parent_id string, concepts array<string>")
        ts = spark.createDataFrame([(t, s, i) for t, ss in assigned.items() for i, s in enumerate(ss)],
                                   "theme_id string, study_id string, pos int")
        tq = spark.createDataFrame([], "theme_id string, quote_id string, pos int")
        return Evidence(st, th, ts, tq)
    return build


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def one(df):
    return df.collect()[0].asDict()
