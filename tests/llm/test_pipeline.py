"""The pipeline against its stages worked out plainly from their operators' results."""

import os
from collections import defaultdict

import corpus_pipeline
import pytest
from tests.conftest import DATA
from tests.llm.conftest import odd_rows

from twinsift.llm import decontaminate, jaccard_join, quality, secrets
from twinsift.llm._util import read

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_every_stage_takes_effect(spark, tmp_path):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    labels = read(spark, DATA, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        kept, after = {r["doc_id"]: r["text"] for r in spark.read.parquet(path).collect()}, spark.read.parquet(path)
        if "quality" in name:
            scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
            assert set(kept) == {d for d in texts if scores[d] == 1}
        elif "Jaccard" in name:
            groups = defaultdict(list)
            for r in jaccard_join.jaccard_components(docs, 5, 80).collect():
                groups[r["component_id"]].append(r["doc_id"])
            assert set(kept) == {min(g) for g in groups.values()}
        elif "decontamination" in name:
            found = {r["doc_id"] for r in decontaminate.find_contamination(docs, read(spark, DATA, "benchmark")).collect()}
            assert found and set(kept) == set(texts) - found
        else:
            assert set(kept) == set(texts)
            for d, (spans,) in zip(texts, ([s] for s in secrets.find_spans(list(texts.values()), secrets.trained())), strict=True):
                assert (kept[d] == texts[d]) == (not spans) and all(texts[d][a:b] not in kept[d] for a, _, b in spans)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        texts, docs = kept, after
    packed = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    assert corpus_pipeline.run(spark, DATA).count() == len(packed) and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, columns with names that operators use."""
    rows = [(i, t, "en", "src1", None if t is None else len(t), "x", 1) for i, t in odd_rows()]
    columns = "doc_id long, text string, lang string, source string, n_chars long, gone string, pseudonyms int"
    kept = {"n-gram Jaccard join": len(rows), "benchmark decontamination": len(rows), "secret scans": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        for given in (rows, []):
            docs = spark.createDataFrame(given, columns)
            out = stage(spark, docs, DATA)
            got = out.collect()
            if name == "packing":
                assert {r["doc_id"] for r in got} == {r[0] for r in given}
                continue
            assert out.columns == docs.columns
            if given and name in kept:
                assert len(got) == kept[name] and sum(r["text"] is None for r in got) == 1
            if not given:
                assert got == []
