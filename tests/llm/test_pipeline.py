"""The pipeline stage by stage against brute force, each on its own input."""

import base64
import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_numbered import brute_components, brute_contamination, brute_repeats

from cohortscale.llm import catalog, quality_kernel, unit_dedup

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept[name], docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        kept[f"{name} out"] = docs.collect()

    model = catalog.quality_model(spark, SF)
    for r in kept["quality"]:
        p = model.probability(quality_kernel.np.array([quality_kernel.text_statistics(r["text"] or "")]))[0]
        assert (p >= catalog.GOOD_AT) == any(k["doc_id"] == r["doc_id"] for k in kept["quality out"])

    texts = [(r["doc_id"], r["text"]) for r in kept["near_duplicates"]]
    want = {d for d, _, c in brute_components(texts) if d == c}
    assert {r["doc_id"] for r in kept["near_duplicates out"]} == want

    texts = [(r["doc_id"], r["text"]) for r in kept["substring_dedup"]]
    spans, after = brute_repeats(texts, unit_dedup.MIN_WORDS), {r["doc_id"]: r["text"] for r in kept["substring_dedup out"]}
    for doc_id, text in texts:
        assert after[doc_id] == "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans[doc_id]))

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [(r["doc_id"], r["text"]) for r in kept["decontamination"]]
    clean = {r[0] for r in brute_contamination(texts, items) if not r[-1]}
    assert {r["doc_id"] for r in kept["decontamination out"]} == clean and len(clean) < len(texts)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = {r["doc_id"]: r for r in kept["encoding out"]}
    assert len(encoded) == len(kept["encoding"])
    for r in kept["encoding"]:
        ids = own.encode_ordinary(r["text"])
        assert encoded[r["doc_id"]]["n_tokens"] == len(ids)
        assert encoded[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter(whole) == Counter(kept["encoding out"])


def test_stages_take_odd_rows(spark, tmp_path):
    """NULLs in every column, no text, repeated rows, and no rows at all."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = "".join(f"The {w} reading of sample {i} was taken by hand and agreed with the earlier one. " for i, w in enumerate("abcdefghij"))
    rows = [(1, good, "en", "s", 3), (1, good, "en", "s", 3), (2, None, None, None, None), (None, good[:300], "en", "s", 2), (3, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= n


def test_texts_go_to_python_once_and_in_small_batches(spark):
    """A batch of Spark's own limit, 64 MB with every text twice, is held by executor and worker of each task."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    docs = spark.createDataFrame([(i, "word " * i, "x") for i in range(1, 9)] + [(9, None, "y")], "doc_id long, text string, _kernel_text string")
    known = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS accepted")
    model = quality_kernel.fit_verdicts(docs, known)
    try:
        scored = quality_kernel.score_verdicts(docs, model)
        assert scored.columns == [*docs.columns, "score"]
        want = model.probability(quality_kernel.np.array([quality_kernel.text_statistics(r.text or "") for r in docs.collect()]))
        assert [(r.doc_id, r._kernel_text) for r in scored.collect()] == [(r.doc_id, r._kernel_text) for r in docs.collect()]
        assert abs(want - [r.score for r in scored.collect()]).max() < 1e-12
        for name in ("quality", "near_duplicates", "substring_dedup", "encoding"):
            spark.conf.set(limit, "64m")
            dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert spark.conf.get(limit) == "4m", name
    finally:
        spark.conf.set(limit, before)
