"""The numbered queries: each maps the given tables to an operator and its rows to the contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.llm import (
    byte_bpe,
    contamination,
    context_mixing,
    frame_codes,
    hilbert,
    jaccard_join,
    language,
    page_text,
    quality_kernel,
    quality_ngrams,
    statement_search,
    suffix_repeats,
    unit_dedup,
)
from cohortscale.llm.rows import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLES[fn.__name__] = sql
    return fn


def query_with(sql: str):
    return lambda fn: query(fn, sql)


#: Probability of label 1 from which a document is good.
GOOD_AT = 0.3


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality labels as review verdicts."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("accepted"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_kernel.KernelModel:
    """Learned from the labelled documents that are not held out."""
    learned = verdicts(spark, sf_dir).filter(~held_out(F.col("doc_id"), 5))
    return quality_kernel.fit_verdicts(table(spark, sf_dir, "documents"), learned)


def sealed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as statements no document may hold."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("statement_id"), F.col("text").alias("statement"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(documents.filter(~held_out(F.col("doc_id"), 5)))
    found = language.detect_languages(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = contamination.mark_contamination(table(spark, sf_dir, "documents"), sealed_statements(spark, sf_dir))
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_kernel.score_verdicts(documents, quality_model(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_AT).cast("int").alias("predicted"),
    )


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = context_mixing.score_documents(documents, documents.filter(~held_out(F.col("doc_id"), 10)))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte",
    )


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_ngrams.apply_rules(documents, quality_ngrams.fit_rules(documents, verdicts(spark, sf_dir)))


def encoded_digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode_documents(documents, ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode_documents(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(spark, table(spark, sf_dir, "documents"))


@query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
    )
    sharded = hilbert.assign_shards(rows, ["text_crc32", "doc_id"], ["lang", "source", "size"], shards=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = unit_dedup.remove_repeated_units(documents)
    return done.select("doc_id", "text", F.size("removed").alias("n_removed"), "removed")


@query
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_repeats.remove_repeated_bytes(documents)
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"),
    )


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """Each round of Lloyd's method as two tables: the nearest entries, and the entries moved."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS place, vec_id, label,
          list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT place, p, v[p * {width} + 1 : p * {width} + {width}] AS s FROM kept, range({parts}) r(p)),
        book0 AS MATERIALIZED (SELECT p, place - 1 AS e, s AS c FROM part WHERE place <= {entries})"""
    ]
    far = "list_sum(list_transform(range(1, {w} + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i])))::BIGINT".format(w=width)
    near = "near{k} AS MATERIALIZED (SELECT place, p, any_value(s) AS s, min((far, e)) AS best FROM (SELECT place, p, s, e, " + far + " AS far FROM part JOIN book{k} USING (p)) GROUP BY place, p)"
    means = ", ".join(f"floor(sum(s[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
    for k in range(rounds):
        steps.append(near.format(k=k))
        steps.append(f"mean{k} AS MATERIALIZED (SELECT p, best[2] AS e, [{means}] AS c FROM near{k} GROUP BY ALL)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    steps.append(near.format(k=rounds))
    return "WITH " + ", ".join(steps) + f""",
      code AS (SELECT place, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY place),
      digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (place), digest"""


@query_with(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.col("embedding").alias("pixels"), F.col("label").alias("vendor")
    )
    codes, codebooks = frame_codes.compress_frames(frames)
    return codes.select(
        F.col("frame_id").alias("vec_id"), "code", "error", F.col("vendor_error").alias("label_error"),
        F.lit(frame_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )


_SEARCH_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
wordy AS (SELECT place, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM wordy),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
words AS (SELECT place, unnest(ts) AS term FROM wordy),
tf AS (SELECT place, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, big_n),
gain AS (SELECT place, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS gain FROM tf JOIN wordy USING (place) JOIN w USING (term), total),
scored AS (SELECT item_id, place, sum(gain)::BIGINT AS score FROM gain JOIN item USING (term) GROUP BY ALL HAVING sum(gain) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored JOIN wordy USING (place))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query_with(_SEARCH_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statement_search.rank_documents(table(spark, sf_dir, "documents"), sealed_statements(spark, sf_dir))
    return found.select(F.col("statement_id").alias("item_id"), "rank", "doc_id", "score")
