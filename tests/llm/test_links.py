"""Every link of a class counts, also between classes of one component."""

import random

from millrace.llm import jaccard_join


def _sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]


def _linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def _texts():
    r = random.Random(3)
    texts = []
    for g, (n, copies) in enumerate([(200, 40), (120, 9), (60, 25), (9, 8), (40, 2)]):
        w = [f"w{g}x{i}" for i in range(n)]
        for _ in range(copies):  # near copies, some of them linked with some others only
            v = list(w)
            for _ in range(r.randint(0, 1 + n // 50)):
                v[r.randrange(n)] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(v[: n - r.randrange(1 + n // 8)]))
    return [*texts, *texts[:5], texts[0].upper(), "a b c", "", None]


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "MATCHES", 1000)
    texts = _texts()
    sets = _sets(texts)
    classes = {frozenset(s) for s in sets}
    want = {i: sum(_linked(s, c) for c in classes if c != s) for i, s in enumerate(sets)}
    got = {x.doc_id: x.n_links for x in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
    partners = {frozenset(s): want[i] for i, s in enumerate(sets)}
    assert max(partners.values()) > 20 and len(set(partners.values())) > 5


def test_components_alone_have_no_counts(spark):
    rows = spark.createDataFrame(list(enumerate(["a b c d e f g h i j k l", "a b c d e f g h i j k l m", "z"])), "doc_id long, text string")
    some, whole = (jaccard_join.jaccard_join(rows, links=links) for links in (False, True))
    assert "n_links" not in some.columns
    assert sorted((x.doc_id, x.component_id, x.n_links) for x in whole.collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]
    assert sorted((x.doc_id, x.component_id) for x in some.collect()) == [(0, 0), (1, 0), (2, 2)]
