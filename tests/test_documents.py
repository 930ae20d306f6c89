"""Loading a document, the whole first-level report, and the result sink."""

import json

import pytest
from conftest import one, rows

from weft.operators import synthesis
from weft.sources.documents import load_evidence, parts, study_texts, write_results

DOC = {
    "name": "demo", "synthesis_type": "meta_ethnography", "concepts": ["self_care", "family"],
    "studies": [
        {"study_id": "S1", "title": "t", "authors": "a", "year": 2019, "key_findings": ["Self care matters.", "Two."],
         "quotes": [{"quote_id": "Q1", "text": "my Family helps"}]},
        {"study_id": "S2", "title": "t", "authors": "a", "year": 2020, "sample_size": 4, "key_findings": []}],
    "themes": [{"theme_id": "T1", "label": "Care", "assigned_studies": ["S1", "S1"], "assigned_quotes": ["Q1"]}],
    "cerqual_findings": [{"finding_id": "F1", "finding_text": "x", "coherence": "minor", "contributing_studies": ["S1"]}]}


@pytest.fixture(scope="module")
def evidence(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "demo.json"
    path.write_text(json.dumps(DOC, indent=1))
    return load_evidence(spark, str(path))


def test_defaults_and_parts(evidence):
    s = {r["study_id"]: r.asDict() for r in evidence.studies.collect()}
    assert s["S1"]["quality_score"] == "moderate" and s["S1"]["sample_size"] == 0 and s["S2"]["quotes"] == []
    assert rows(parts(evidence.studies)) == [("S1", 0, "Self care matters."), ("S1", 1, "Two."), ("S1", 2, "my Family helps")]
    assert dict(rows(study_texts(evidence.studies))) == {"S1": "Self care matters. Two. my Family helps", "S2": ""}
    assert rows(evidence.theme_studies) == [("T1", "S1", 0)]


def test_report_and_sink(spark, evidence, tmp_path):
    report = synthesis.run_synthesis(evidence)
    assert rows(report["translation"].filter("type = 'present'"), "study_id", "concept") == [("S1", "family"), ("S1", "self_care")]
    assert one(report["findings"])["overall_confidence"] == "Moderate"
    got = one(report["summary"])
    assert got["certification"] == "PASS" and got["synthesis_type"] == "meta_ethnography"
    text = '[{"id": "S1", "n": 0, "year": 2019}, {"id": "S2", "n": 4, "year": 2020}]'
    import hashlib
    assert got["input_hash"] == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert one(report["theme_summary"])["study_coverage"] == 0.5
    write_results(report, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "coverage")).count() == 1


def test_several_documents_are_numbered_one_after_the_other(spark, tmp_path):
    for name in ("b", "a"):
        doc = DOC | {"name": name, "concepts": ["c", name], "studies": [s | {"study_id": name + s["study_id"]} for s in DOC["studies"]],
                     "themes": [t | {"theme_id": name + "T"} for t in DOC["themes"]]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    ev = load_evidence(spark, str(tmp_path))
    assert [r["study_id"] for r in ev.studies.orderBy("ord").collect()] == ["aS1", "aS2", "bS1", "bS2"]
    assert ev.studies.select("ord").distinct().count() == 4
    assert ev.concepts == ["c", "a", "b"]
    assert [r["study_id"] for r in load_evidence(spark, str(tmp_path), "b").studies.orderBy("ord").collect()] == ["bS1", "bS2"]


def test_fingerprint_of_blocks(spark):
    import hashlib
    df = spark.createDataFrame([(f"S{i}", i, i, 2000) for i in range(25)], "study_id string, ord bigint, sample_size int, year int")
    def digest(lo, hi):
        return hashlib.sha256(("[" + ", ".join(f'{{"id": "S{i}", "n": {i}, "year": 2000}}' for i in range(lo, hi)) + "]").encode()).hexdigest()
    want = hashlib.sha256(f"[{digest(0, 10)}, {digest(10, 20)}, {digest(20, 25)}]".encode()).hexdigest()[:16]
    assert one(synthesis.input_fingerprint(df, block=10))["input_hash"] == want
    assert one(synthesis.input_fingerprint(df))["input_hash"] == digest(0, 25)[:16]
