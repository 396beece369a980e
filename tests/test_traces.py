"""Checks of recorded traces, the first fault first, and pages of reports."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import copies, findings, traces

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
EVENT = "unit string, number int, before int, after int, `order` array<int>, register int, success boolean, function string, uid int"


def event(unit, number, before, after, register, success, order=(2, 0, 1), function="f", uid=1):
    return (unit, number, before, after, list(order), register, success, function, uid)


def test_histories(spark):
    rows = [
        *(event("good", *e) for e in ((0, 0, 1, 2, True), (1, 1, 2, 0, True), (2, 2, 0, None, False), (3, 0, 0, 1, True))),
        event("starts late", 1, 0, 1, 2, True),
        event("jumps", 0, 0, 1, 2, True),
        event("jumps", 1, 0, 2, 0, True),
        event("order", 0, 0, 1, 2, True, order=(0, 0, 1)),
        event("beyond", 0, 0, 3, 2, True),
        event("unnamed", 0, 0, 1, 2, True, function=""),
        event("no uid", 0, 0, 1, 2, True, uid=0),
        event("stays", 0, 0, 1, 0, True),
        event("keeps", 0, 0, 0, 1, False),
        event("moves", 0, 0, 2, None, False),
        event("two", 0, 0, 1, 1, True),
        event("two", 1, 5, 1, 2, True),
    ]
    got = {r.unit: (r.number, r.fault) for r in traces.history_faults(spark.createDataFrame(rows, EVENT), F.lit(3)).collect()}
    assert got == {
        "starts late": (1, "discontinuous"), "jumps": (1, "discontinuous"), "order": (0, "invalid order"), "beyond": (0, "invalid event"), "unnamed": (0, "invalid event"), "no uid": (0, "invalid event"),
        "stays": (0, "does not advance"), "keeps": (0, "does not reset"), "moves": (0, "does not reset"), "two": (0, "does not advance"),
    }


def test_first_fault_of_a_trace(spark):
    units = [("good", True, 0, 0), ("changed", False, 0, 0), ("gone", True, 0, 0), ("unverified", None, 1, 0), ("failed", True, 1, 0), ("errors", True, 0, 3), ("history", True, 0, 0)]
    collections = spark.createDataFrame([(*u, 3) for u in units], "unit string, verified boolean, exit_code int, n_errors int, n_registers int")
    files = spark.createDataFrame([(u, "events.json", u) for u, *_ in units if u != "gone"], "unit string, path string, content string")
    artifacts = spark.createDataFrame([(u, "events.json", SHA("x" if u == "changed" else u)) for u, *_ in units], "unit string, path string, sha256 string")
    events = spark.createDataFrame([event(u, 0, 0, 1, 0 if u == "history" else 2, True) for u, *_ in units], EVENT)
    faults = traces.trace_faults(collections, artifacts, files, events)
    want = {"changed": "artifact changed", "gone": "artifact missing", "unverified": "object not verified", "failed": "incomplete trace", "errors": "incomplete trace", "history": "does not advance"}
    assert {r.unit: r.fault for r in faults.collect()} == want
    with pytest.raises(Exception, match="failed: incomplete trace"):
        traces.require(faults.where("unit = 'failed'")).collect()
    assert traces.require(faults.where("unit = 'good'")).count() == 0


def test_faults_of_dumps(spark):
    collections = spark.createDataFrame([("a", "d", None), ("b", "d", "w"), ("c", "d", "w"), ("d", "d", None), ("e", "d", None)], "unit string, dump string, warnings string")
    files = spark.createDataFrame([(u, p, u + p) for u in "abcde" for p in "dw"], "unit string, path string, content string")
    artifacts = spark.createDataFrame([(u, p, SHA("x" if (u, p) in (("c", "w"), ("d", "d")) else u + p)) for u in "abcde" for p in "dw"], "unit string, path string, sha256 string")
    functions = spark.createDataFrame([(u, "f", "code", "r" if u != "e" else "s") for u in "abcde"], "unit string, symbol string, code string, relocations string")
    canonical = functions.withColumn("relocations", F.lit("r"))
    got = {r.unit: r.fault for r in traces.dump_faults(collections, functions, canonical, artifacts, files).collect()}
    assert got == {"c": "warnings changed", "d": "dump changed", "e": "function differs"}
    assert {r.fault for r in traces.dump_faults(collections, functions, canonical.limit(0), artifacts, files).collect()} == {"function differs"}


def test_calls_cancel_by_name_then_by_address(spark):
    call = "unit int, function string, callee string, n long"
    ours = spark.createDataFrame([(1, "f", "same", 2), (1, "f", "known", 3), (1, "f", "placed", 1), (1, "f", "mine", 1)], call)
    theirs = spark.createDataFrame([(1, "f", "same", 1), (1, "f", "sub_1F", 2), (1, "f", "sub_20", 1), (1, "f", "sub_21", 4), (1, "f", "other", 1)], call)
    named = spark.createDataFrame([(0x1F, "known"), (0x21, "named")], "address long, symbol string")
    placed = spark.createDataFrame([(1, "placed", 0x20, 5)], "unit int, symbol string, address long, size long")
    got = {(r.side, r.callee): r.n for r in copies.call_differences(ours, theirs, named, placed).collect()}
    assert got == {("ours", "same"): 1, ("ours", "known"): 1, ("ours", "mine"): 1, ("theirs", "named"): 4, ("theirs", "other"): 1}


def test_frames_need_equal_sizes_calls_and_places(spark):
    schema = "unit string, symbol string, address long, known_address long, size long, target_size long, calls int, target_calls int, score double, exact boolean"
    base = ("u", "s", 1, 1, 8, 8, 2, 2, 90.0, False)
    rows = [base, ("t", *base[1:])]
    for i, change in enumerate([(3, 9), (5, 9), (7, 3), (8, 100.0), (9, True), (3, None), (5, None)], 2):
        row = list(base)
        row[2] = row[3] = i
        row[change[0]] = change[1]
        rows.append(tuple(row))
    causes = spark.createDataFrame([(1, "register-allocation")] + [(i, "padding") for i in range(2, 9)], "address long, cause string")
    census = findings.frame_census(spark.createDataFrame(rows, schema), causes)
    assert [(r.address, r.category, r.n_units, r.first_unit) for r in census.collect()] == [(1, "register-only", 2, "t")]
    assert [tuple(r) for r in findings.register_groups(census).collect()] == [("t", 1, 8)]
