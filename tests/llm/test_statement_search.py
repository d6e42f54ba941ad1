"""Ranked search of report documents against scoring every pair of document and statement."""

import math
import re
from collections import Counter

import pytest

from cohortscale.llm.statement_search import rank_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STATEMENTS = "statement_id long, statement string, score int"
DOCS = "doc_id long, text string, score double, rank string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranks(documents, statements, top=10):
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t in documents if terms(t)]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted: dict = {}
    for statement_id, statement in statements:
        wanted.setdefault(statement_id, set()).update(terms(statement))
    out = []
    for statement_id, own in wanted.items():
        scored = []
        for doc_id, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own if c[t]}
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top]
        out += [(statement_id, k, s[2], -s[0]) for k, s in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def reports(spark):
    prose = [f"Fluid {k % 7} graded; vendor-{k % 5} Cirrus ÄÖ_x fold{k % 11} " * (1 + k % 4) for k in range(60)]
    rows = [(k, t, None, "x") for k, t in enumerate(prose)]
    rows += [(100, None, 1.0, None), (101, "", None, None), (102, " .,; ", None, None), (None, prose[3], None, None)]
    rows += [(103, prose[5], None, None), (103, prose[5], None, None), (104, "dice " * 30_000 + "cirrus", None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(1, "Cirrus fluid 3", 0), (2, "fold7 fold7 FOLD7, dice!", 1), (3, None, 2), (4, "", 3), (5, "nothing-of-it", None), (2, "Vendor", 9), (None, "äö ÄÖ graded", 1)]
    return spark.createDataFrame(rows, STATEMENTS)


@pytest.mark.parametrize("index_bytes", [8 << 20, 200])
def test_ranks_match_brute_force(reports, claims, index_bytes):
    docs = [(r["doc_id"], r["text"]) for r in reports.collect()]
    want = brute_ranks(docs, [(r["statement_id"], r["statement"]) for r in claims.collect()])
    assert want and found(rank_documents(reports, claims, index_bytes=index_bytes)) == want


def test_fewer_and_ties(reports, claims):
    docs = [(r["doc_id"], r["text"]) for r in reports.collect()]
    one = claims.filter("statement_id = 1")
    assert found(rank_documents(reports, one, top=3)) == brute_ranks(docs, [(1, "Cirrus fluid 3")], top=3)


def test_empty_tables(spark, reports, claims):
    nothing = spark.createDataFrame([], DOCS)
    assert rank_documents(nothing, claims).count() == 0
    assert rank_documents(reports, spark.createDataFrame([], STATEMENTS)).count() == 0
    silent = spark.createDataFrame([(1, "...", None, None)], DOCS)
    assert rank_documents(silent, claims).columns == ["statement_id", "rank", "doc_id", "score"]
    assert rank_documents(silent, claims).count() == 0
