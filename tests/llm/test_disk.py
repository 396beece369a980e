"""What an operator leaves on disk while it runs."""

import os
import time

from millrace.llm import common as C
from millrace.llm import jaccard_join

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)
    set_to = spark.conf.get(CLEANUP)
    rows = spark.range(200_000).selectExpr("id % 50021 as k", "id").groupBy("k").count()
    written = C.materialise(rows, "counts")
    assert written.count() == 50021 and spark.conf.get(CLEANUP) == set_to
    until = time.time() + 5
    while (left := {f for f in _shuffle_files(spark) - before if f.endswith(".data")}) and time.time() < until:
        time.sleep(0.1)
    assert len(left) <= 1  # that of the count above, which is no write


def test_near_copies_are_found_in_turns_without_keeping_their_tables(spark, monkeypatch):
    held = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, path, *a: (written(df, path, *a), held.append({os.path.basename(p).rsplit("-", 1)[0] for p in spark._millrace_tables if os.path.exists(p)}))[0])
    long = [[f"w{g}x{i}" for i in range(60)] for g in range(6)]
    texts = [" ".join(w[:k] + [f"new{g}"] + w[k + 1 :]) for g, w in enumerate(long) for k in (0, 59, 30)] + ["a b c d e f", "a b c d e f", "", None]
    C.clear(spark)
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in got.collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    want = {i: i for i in range(len(texts))}
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(want.values())) < len(texts)
    at_end = {os.path.basename(p).rsplit("-", 1)[0] for p in spark._millrace_tables}
    assert not at_end & {"entries", "shared", "members", "lists", "leads", "texts", "named", "open", "pairs"}
    assert not any("entries" in h and "lists" in h for h in held)
