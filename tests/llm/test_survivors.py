"""One row of each group of near copies, also where an id is repeated with different texts."""

import brute

import corpus_pipeline
from segue.llm import simhash


def groups_of(links, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_one_row_of_each_group(make_docs, odd_rows):
    """An id repeated with different texts names several groups: each keeps its document."""
    kept = sorted((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(make_docs(odd_rows)).where("doc_id IS NOT NULL").collect())
    prints = [brute.simhash(t) for _, t in odd_rows]
    groups = groups_of([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], len(prints))
    named = {g: min(d for (d, _), h in zip(odd_rows, groups) if h == g and d is not None) for (d, _), g in zip(odd_rows, groups) if d is not None}
    assert sorted(d for d, _ in kept) == sorted(named.values()) and {t for d, t in kept if d == 12} == {t for d, t in odd_rows if d == 12}


def test_stage_keeps_both_texts_of_an_id(spark, make_docs):
    say = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(12, say("a")), (12, say("b")), (13, say("b"))]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, make_docs(rows), "").collect()]
    assert sorted(kept) == rows[:2]
