"""The whole pipeline on odd rows, against its operators' plain versions."""

from collections import Counter

import corpus_pipeline

from .test_operators import SCHEMA, bench_rows, brute_components, odd_rows, plain


def write(spark, folder, rows, labels=True):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench_rows(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_columns_and_work_on_what_is_kept(spark, tmp_path):
    folder = write(spark, tmp_path, odd_rows())
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.stash(stage(spark, docs, folder), name)
        assert docs.columns == columns
        rows = docs.collect()
        sizes.append(len(rows))
        texts = Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "near_duplicates":
            kept = {x[0:2] for x in brute_components([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.NEAR) if x[3] or x[0] is None}
            assert all((r["doc_id"], len({tuple(plain(r["text"])[i : i + 5]) for i in range(max(1, len(plain(r["text"])) - 4))}) if plain(r["text"]) else 0) in kept for r in rows if r["doc_id"] is not None)
        if name != "mixing":
            assert not texts - Counter((r["doc_id"], r["text"]) for r in before)
        else:
            assert set(texts) <= {(r["doc_id"], r["text"]) for r in before}
    assert sizes[1] < sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())


def test_run_equals_its_stages(spark, tmp_path):
    folder = write(spark, tmp_path, odd_rows())
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    first = sorted(map(str, rows.collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", [])).count() == 0
    kept = corpus_pipeline.run(spark, write(spark, tmp_path / "b", odd_rows(), labels=False))
    assert kept.count() > 0  # without labels every score is 1/2, which is accepted
