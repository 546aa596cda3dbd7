"""Every stage of the pipeline against a plain version over its own input."""

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_simhash import brute_copies

from treeline.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        assert docs.columns == columns
        seen[name] = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "near_dedup":
            first = {}
            for r, group in sorted(zip(before, brute_copies([r.text for r in before])), key=lambda x: x[0].doc_id):
                first.setdefault(group, r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(first.values())
        if name == "decontamination":
            assert sorted(rows) == sorted(r for r in before if not contaminated(r.text, items)[1])
        if name == "mix":
            sizes, taken = {}, {}
            for table, out in ((before, sizes), (rows, taken)):
                for r in table:
                    out[r.source] = out.get(r.source, 0) + len(r.text.split())
            wanted = mixing.targets([sizes[s] for s in sorted(sizes)])
            assert all(abs(taken[s] - t) <= 1 for s, t in zip(sorted(sizes), wanted))
    assert 0 < seen["decontamination"] < seen["near_dedup"] < seen["quality"] < 200
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).orderBy("start").collect()
    assert len(out) == seen["mix"]
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
