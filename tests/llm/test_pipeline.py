"""The pipeline against its stages' own definitions, on the smallest tables."""

import corpus_pipeline

from tests.llm.test_operators import components, contamination, fingerprint, lower


def test_pipeline_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.collect()}
        assert after <= set(before)
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[lower(t)] = max(i, best.get(lower(t), -1))
            assert after == set(best.values())
        elif name == "simhash_near_dedup":
            assert after == set(components({i: fingerprint(t) for i, t in before.items()}).values())
        elif name == "benchmark_decontamination":
            assert after == {i for i, e in contamination(before.items(), bench).items() if not e[4]}
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, extra columns, and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, _gone_0 int, _trusted int, _GONE_1 int"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    texts = [" ".join(words[(i * k) % 18] for k in range(1, 40)) for i in range(1, 12)]
    rows = [(i, t, "en", "s", 1, 2, 3, 4, 5) for i, t in enumerate(texts)] + [(None, texts[0], None, "s", 1, 2, 3, 4, 5), (5, None, "en", "s", 1, 2, 3, 4, 5), (5, "", "en", "s", 1, 2, 3, 4, 5), (3, texts[3].upper(), "en", "s", 1, 2, 3, 4, 5), (None, None, None, None, None, None, None, None, None), (90, "the passage of the benchmark is a text of exactly as many words as it needs", "en", "s", 1, 2, 3, 4, 5)]
    for name, data in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"file://{at}/documents.parquet")
        spark.createDataFrame([(90, 1)] if name == "some" else [], "doc_id bigint, quality int").where("quality = 5").write.parquet(f"file://{at}/labels.parquet")
        spark.createDataFrame([(1, "The passage of the benchmark is a text of exactly as many words")], "item_id bigint, text string").write.parquet(f"file://{at}/benchmark.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}/some")
        assert out.schema == docs.schema
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/some").collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert 90 not in ids and 5 in ids and all(r.n_tokens for r in got)
    assert [i for i in set(ids) if ids.count(i) > 1] == [3]  # equal text and equal id: one document
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_intermediates_are_deleted(spark, small):
    from pathlib import Path

    from tessera.llm.shared import own_dir

    folder = Path(own_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    corpus_pipeline.run(spark, small).count()
    left = sorted(p.name for p in set(folder.iterdir()) - before)
    assert len([n for n in left if n.startswith("pipeline-")]) == 1 and len(left) <= 2
