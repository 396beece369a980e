"""Registered queries read their whole tables: against brute force on small fixtures."""

import random

from millrace.plans import catalog


def test_fixpoint_components_of_all_lines(spark, tmp_path):
    r = random.Random(5)
    lines = [(r.randrange(60), r.randrange(100)) for _ in range(90)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    label = {p: p for _, p in lines}
    for _ in lines:  # at most so many rounds until nothing changes
        for order in {o for o, _ in lines}:
            parts = [p for o, p in lines if o == order]
            low = min(label[p] for p in parts)
            label |= {p: low for p in parts}
    assert 1 < len(set(label.values())) < len(label)
    got = {x.node: x.label for x in catalog.QUERIES["fixpoint_components"](spark, str(tmp_path)).collect()}
    assert got == label


def test_align_documents_to_their_end(spark, tmp_path):
    n = 1_000_000
    text = " ".join(map(str, range(n)))
    spark.createDataFrame([(1, text + " a b"), (2, text + " a c d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(x.doc_id, x.n_equal, x.n_replaced, x.n_deleted, x.n_inserted, x.first_difference) for x in catalog.QUERIES["align_documents"](spark, str(tmp_path)).collect()]
    assert got == [(1, n + 1, 2, 0, 0, n + 1)]
