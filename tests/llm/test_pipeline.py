"""The pipeline's stages against brute force, and what the driver relies on."""

import __spark_entry__ as E
import corpus_pipeline
from shelfwise.llm import quality
from shelfwise.llm.queries import QUERIES
from tests.llm.test_documents import base_spans, shingles


def test_every_operator_has_one_query():
    names = E.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "personal_data", "mix_sources", "encode"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name != "encode":
            assert out[name].schema == docs.schema
            docs = out[name]
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in out["quality_rules"].collect()} == kept
    sets = {i: shingles(first[i]) for i in sorted(kept)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in out["near_copies"].collect()} == {i for i in sets if find(i) == i}
    marked = {r["doc_id"]: r for r in out["personal_data"].collect()}
    assert set(marked) == {i for i in sets if find(i) == i}
    for i, r in marked.items():
        assert r["n_chars"] == len(r["text"])
        for span in base_spans(first[i]):
            _, a, b = span.split(":")
            assert first[i][int(a):int(b)] not in r["text"]
        if not any(c.isdigit() for c in first[i]) and "@" not in first[i]:
            assert r["text"] == first[i]
    mixed = out["mix_sources"].collect()
    assert {r["doc_id"] for r in mixed} == set(marked)
    final = out["encode"].collect()
    assert all(r["decodes"] for r in final) and len(final) == 2 * len(mixed)
