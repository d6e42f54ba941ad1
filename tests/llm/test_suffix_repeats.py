"""Repeated byte strings against counting every string of every text."""

import random
from collections import Counter

import pytest

from cohortscale.llm.rows import row_key
from cohortscale.llm.suffix_repeats import LOT, adjacent_prefixes, remove_repeated_bytes, repeated_windows, sorted_suffixes

DOCS = "doc_id long, text string, removed_by string, score double"


def brute_removed(documents, n):
    seen = Counter()
    texts = [(t or "").encode() for _, t in documents]
    for t in texts:
        seen.update(t[k : k + n] for k in range(len(t) - n + 1))
    out = []
    for (doc_id, _), t in zip(documents, texts):
        gone = [False] * len(t)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        edges = [0] + [k for k in range(1, len(t)) if gone[k] != gone[k - 1]] + [len(t)]
        runs = [(a, b) for a, b in zip(edges, edges[1:]) if b > a and gone[a]]
        out.append((doc_id, bytes(c for c, g in zip(t, gone) if not g), runs))
    return sorted(out, key=repr)


def found(df):
    rows = ((r["doc_id"], bytes(r["kept"] or b""), [(s["start"], s["end"]) for s in r["removed"]]) for r in df.collect())
    return sorted(rows, key=repr)


def report_texts(seed, n=40):
    """Passages put into different surroundings, copies, near copies, runs, odd characters."""
    rng = random.Random(seed)
    words = [f"grade{k}" for k in range(40)] + ["fluid", "scan", "ÄÖ", "漢字", "\U0001f600", "a", "\x00"]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passages = [prose(25) for _ in range(4)]
    texts = []
    for k in range(n):
        kind = k % 5
        if kind < 2:
            texts.append(prose(rng.randint(0, 40)) + rng.choice(passages) + prose(rng.randint(0, 40)))
        elif kind == 2:
            texts.append(rng.choice(texts))
        elif kind == 3:
            near = list(rng.choice(texts) or "x")
            near[rng.randrange(len(near))] = "#"
            texts.append("".join(near))
        else:
            texts.append(prose(rng.randint(0, 12)))
    texts += ["mask " * 200, "mask " * 150 + "end", "ab" * 300, "z" * 500, "", None, " \n"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "group"), [(60, 1024), (60, 2), (9, 3), (150, 1)])
def test_matches_brute_force(spark, n, group, monkeypatch):
    monkeypatch.setattr("cohortscale.llm.suffix_repeats.repeated_windows.__defaults__", (group,))
    docs = report_texts(n + group)
    docs += [docs[0], docs[0], (None, docs[1][1]), (None, None), (77, docs[5][1])]
    rows = spark.createDataFrame([(*d, "x", None) for d in docs], DOCS).repartition(3)
    assert found(remove_repeated_bytes(rows, min_bytes=n)) == brute_removed(docs, n)


def test_hot_anchor_is_cut_finer(spark):
    """One passage in very many surroundings: more different pieces around its anchors than a group may have."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=450))
    docs = [(k, "".join(rng.choices("ijklmn", k=30)) + passage + "".join(rng.choices("opqrst", k=30))) for k in range(60)]
    docs += [(100, passage[100:]), (101, passage[20:] + "x" * 500), (102, passage[:405])]
    rows = spark.createDataFrame([(*d, "x", None) for d in docs], DOCS)
    keyed = rows.select("*", *row_key("doc_id", "text"))
    assert repeated_windows(keyed, 400, group=8).count() == 62
    assert found(remove_repeated_bytes(rows)) == brute_removed(docs, 400)


def test_very_long_text_and_empty_table(spark):
    """A text longer than a task takes at a time, repeated where it is cut."""
    rng = random.Random(5)
    long = "".join(rng.choices("abcdef", k=LOT))
    docs = [(1, long), (2, long[LOT // 2 - 300 : LOT // 2 + 300] + "!" + long[3000:3300]), (3, "short")]
    rows = spark.createDataFrame([(*d, "x", None) for d in docs], DOCS)
    assert found(remove_repeated_bytes(rows, min_bytes=100)) == brute_removed(docs, 100)
    nothing = spark.createDataFrame([], DOCS)
    done = remove_repeated_bytes(nothing)
    assert done.columns == [*nothing.columns, "kept", "removed"] and done.count() == 0
    with pytest.raises(ValueError):
        remove_repeated_bytes(nothing, min_bytes=0)


def test_suffixes_are_sorted_in_two_stages():
    rng = random.Random(2)
    for text in (b"", b"a", b"mississippi", b"aaaa", b"\xff\x00\xff", bytes(rng.choices(b"ab", k=300)), bytes(rng.choices(range(256), k=500))):
        order = sorted_suffixes(text, len(text) + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        shared = [next((i for i in range(12) if text[a + i : a + i + 1] != text[b + i : b + i + 1] or a + i >= len(text)), 12) for a, b in zip(order, order[1:])]
        assert [min(c, len(text) - max(a, b)) for c, a, b in zip(adjacent_prefixes(text, order, 12), order, order[1:])] == shared
