"""Records of any shape, leaf by leaf, against a walk over the parsed text."""

import json
import math

from cohortscale.operators import reconcile
from cohortscale.operators.reconcile import ABSENT, UNCOMPARED, compare_records, record_leaves


def walk(node, path=""):
    if isinstance(node, dict):
        for k, x in node.items():
            if path or k not in UNCOMPARED:
                yield from walk(x, f"{path}/{k}")
    elif isinstance(node, list):
        yield f"{path}#len", len(node)
        for k, x in enumerate(node):
            yield from walk(x, f"{path}[{k}]")
    else:
        yield path, node


def same(a, b):
    both = isinstance(a, float) and isinstance(b, float)
    return (both and math.isnan(a) and math.isnan(b)) or a == b


def brute_differences(before, after):
    out = []
    for key in before.keys() | after.keys():
        a = dict(walk(json.loads(before[key]))) if key in before else {}
        b = dict(walk(json.loads(after[key]))) if key in after else {}
        out += [(key, p) for p in a.keys() | b.keys() if not same(a.get(p, ABSENT), b.get(p, ABSENT))]
    return sorted(out, key=repr)


BEFORE = {
    "a": json.dumps(
        {
            "utc": "1", "notes": ["x"], "per_volume": [1, 2], "fold": "f0", "n": 3, "vendors": ["c", "s", "t"],
            "est": {"c": {"IRF": {"dice": {"value": 0.1 + 0.2, "ci": [0.1, float("nan")], "utc": "inner"}}}, "empty": {}, "none": None, "nil": []},
            "text": 'NaN, "Infinity": \\ -Infinity', "big": 2**70, "wide": 12345678901234567, "neg": -0.0, "tiny": 5e-324, "flag": True, "deep": [[[1], []], {"k": [{"z": 1e300}]}],
        }
    ),
    "b": "[1, 2, {\"x\": 1.5}]",
    "c": "3",
    None: '{"v": 1}',
    "gone": '{"v": [1]}',
}
AFTER = {
    "a": BEFORE["a"].replace('"n": 3', '"n": 3.0').replace('"c", "s", "t"', '"c", "t"').replace("0.30000000000000004", "0.3")
    .replace('"utc": "1"', '"utc": "2"').replace("NaN]", "NaN, Infinity]").replace("12345678901234567", "12345678901234568").replace('"flag": true', '"flag": 1'),
    "b": '[1, 2, {"x": 1.50, "y": null}]',
    "c": '"3"',
    None: '{"v": 2}',
    "new": '{"v": {}}',
}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "record string, document string")


def test_leaves_are_those_of_the_parsed_records(spark):
    got = sorted(((r.record, r.path) for r in record_leaves(frame(spark, BEFORE), ["record"]).collect()), key=repr)
    assert got == sorted(((k, p) for k, d in BEFORE.items() for p, _ in walk(json.loads(d))), key=repr)


def test_differences_are_exact(spark):
    found = compare_records(frame(spark, BEFORE), frame(spark, AFTER), ["record"]).collect()
    assert sorted(((r.record, r.path) for r in found), key=repr) == brute_differences(BEFORE, AFTER)
    by = {(r.record, r.path): (r.before, r.after) for r in found}
    assert by["a", "/vendors#len"] == ("3", "2") and by["a", "/vendors[2]"] == ('"t"', ABSENT)
    assert by["a", "/est/c/IRF/dice/ci[2]"] == (ABSENT, "Infinity")
    assert compare_records(frame(spark, BEFORE), frame(spark, BEFORE), ["record"]).count() == 0


def test_unreadable_and_empty(spark):
    bad = spark.createDataFrame([("a", "{"), ("b", None), ("c", "{}")], "record string, document string")
    assert sorted((r.record, r.path, r.value) for r in record_leaves(bad, ["record"]).collect()) == [("a", "", "<unreadable>"), ("b", "", "<unreadable>")]
    assert compare_records(bad.filter("false"), bad.filter("false"), ["record"]).count() == 0


def test_a_level_has_as_many_tasks_as_the_records(spark):
    """However deep the records, tasks grow by level, not twofold with each."""
    deep = '{"a": [{"b": [{"c": [1, null]}]}], "d": 2}'
    rows = spark.createDataFrame([(i, deep) for i in range(6)], "record int, document string").repartition(3)
    out = record_leaves(rows, ["record"])
    assert out.rdd.getNumPartitions() <= 3 * 7
    paths = {"/d", "/a#len", "/a[0]/b#len", "/a[0]/b[0]/c#len", "/a[0]/b[0]/c[0]", "/a[0]/b[0]/c[1]"}
    assert {(r.record, r.path) for r in out.collect()} == {(i, p) for i in range(6) for p in paths}


def test_records_are_compared_in_rounds_as_at_once(spark, monkeypatch):
    """However many rounds, and with keys that are NULL or repeat: the same differences."""
    def made(k, changed):
        return json.dumps({"a": {"x": [k, k + (k % 3 == 0) * changed], "n": None if k % 4 else "t"}, "b": float("nan"), **({"c": 1} if changed and k % 5 == 0 else {})})

    def side(changed):
        rows = [(k if k % 7 else None, made(k, changed)) for k in range(40) if not changed or k % 11] + [(3, made(3, changed))]
        return spark.createDataFrame(rows, "k INT, document STRING")

    def differences():
        out = reconcile.compare_records(side(False), side(True), ["k"])
        return sorted(map(repr, map(tuple, out.collect())))

    want = differences()
    monkeypatch.setattr(reconcile, "LEAVES", 20)
    stores, storing = [], reconcile.stored
    monkeypatch.setattr(reconcile, "stored", lambda df: stores.append(df.columns) or storing(df))
    assert differences() == want and len(want) > 30
    assert sum("before" in columns for columns in stores) == reconcile.ROUNDS  # a round's leaves are shuffled at a time
