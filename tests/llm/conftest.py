import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, size long, target double, id long, body string, "
        "whole string, keep string, n_words long, quality double, row_id long, part int")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with the given (doc_id, text[, lang[, source]]) and further columns whose names operators use inside."""
    def make(rows):
        full = []
        for row in rows:
            doc, text, lang, source = [*row, None, None][:4]
            full.append((doc, text, lang, source, None if text is None else len(text), -1, -1.0, -1, "x", "x", "x", -1, -1.0, -1, -1))
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeated rows, repeated ids, near copies, shared lines and a very long text."""
    rng = random.Random(7)
    vocab = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = say(60) + "\n" + say(40)
    license_line = "  Permission Is hereby GRANTED to any person obtaining a copy of this é "
    rows = [(1, base), (2, base), (3, base.replace("word1", "word2", 1)), (4, None), (5, ""), (6, "   \n\t "), (None, base), (None, say(30)),
            (8, "one two"), (8, "one two"), (9, say(20000)), (10, "\n\n"), (11, say(25) + "\x0b" + say(3)), (12, "A b"), (12, say(80))]
    rows += [(20 + i, say(20) + "\n" + license_line + ("\n" + license_line.upper() if i == 3 else "") + "\n" + say(5)) for i in range(7)]
    rows += [(40 + i, " ".join(base.split()[:50]) + " " + say(30 + i)) for i in range(4)]
    rows += [(70, base + " " + say(20)), (70, rows[-1][1]), (71, rows[-2][1]), (71, rows[-2][1])]
    rows += [(60, "ab " * 100), (61, "!!! ### " * 30), (62, "SHOUT!! " * 40), (63, " ".join(x for w in base.split() for x in (w, w, w)))]
    return rows
