"""Substring dedup where several texts have the same id or none."""

import brute

from segue.llm import spans


def say(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def compare(make_docs, rows):
    got = [tuple(r) for r in spans.digests(make_docs(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute.substring_dedup(rows), key=str)
    return got


def test_null_ids_keep_words_of_their_own(make_docs):
    """Two texts without id, of which only one shares a window: the other loses nothing."""
    rows = [(1, say("a", 30)), (None, say("a", 20) + " " + say("b", 20)), (None, say("c", 40))]
    assert sorted(r[2] for r in compare(make_docs, rows)) == [0, 0, 20]


def test_null_ids_with_shared_anchors_on_both_sides(make_docs):
    rows = [(1, say("a", 30)), (2, say("d", 30)), (None, say("x", 3) + " " + say("a", 20) + " " + say("b", 20)), (None, say("d", 25) + " " + say("c", 40))]
    compare(make_docs, rows)


def test_source_id_with_two_texts(make_docs):
    """Both texts of the source share windows at the same positions with others: nothing repeated stays."""
    rows = [(1, say("a", 40)), (1, say("b", 40)), (2, say("z", 5) + " " + say("a", 30)), (3, say("y", 7) + " " + say("b", 35)), (2, say("b", 18) + " " + say("q", 9))]
    assert sorted(r[2] for r in compare(make_docs, rows)) == [0, 0, 18, 30, 35]
