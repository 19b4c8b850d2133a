"""Quality rules that vote or abstain; their accuracies come from expectation-maximisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.store import saved

#: Rules vote bad (-1) or good (1) and abstain (0) where their measure says little.
RULES: dict[str, str] = {
    "word_length": "CASE WHEN word_chars > 12 * n_words OR word_chars < 2 * n_words THEN -1 ELSE 0 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 ELSE 0 END",
    "repeated_lines": "CASE WHEN n_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines THEN -1 ELSE 0 END",
    "repeated_words": "CASE WHEN n_words >= 10 AND 10 * n_repeat_words > n_words THEN -1 ELSE 0 END",
    "stutter": "CASE WHEN n_words >= 10 AND 10 * n_stutters > 3 * n_words THEN -1 ELSE 0 END",
    "capitals": "CASE WHEN 10 * n_capitals > 3 * word_chars THEN -1 ELSE 0 END",
    "shouting": "CASE WHEN 10 * n_shouts > n_words THEN -1 ELSE 0 END",
    "length": "CASE WHEN n_words < 10 THEN -1 ELSE 0 END",
    "prose": "CASE WHEN 50 * n_symbols <= n_words AND 10 * n_capitals <= word_chars AND 50 * n_stutters <= n_words "
             "AND n_ends > 0 AND 2 * n_ends <= n_words AND 60 * n_ends >= n_words THEN 1 ELSE 0 END",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_stutters", "n_ends"]
#: Accuracy of every rule at the start and its bounds; steps.
START, LOWEST, HIGHEST, STEPS = 0.8, 0.55, 0.99, 40
WINDOW, KEEP = 5, 0.5


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_BLANKS = "' \\t\\n\\u000B\\u000C\\r'"
_WORDS = f"filter(split(body, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"
_REPEATED = _let(f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(WINDOW))}))", "h",
                 "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
                 + _let("sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))", "t",
                        "aggregate(sort_array(transform(filter(sequence(0, size(t) - 1), k -> "
                        "coalesce(get(t, k).x = get(t, k - 1).x, false) OR coalesce(get(t, k).x = get(t, k + 1).x, false)), k -> get(t, k).i)), "
                        f"struct(-{WINDOW} AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n)")
                 + " END")


def measured(docs: DataFrame) -> DataFrame:
    """Adds the measures of every whole text, in one pass over it and inside its row.

    Windows of five words are compared by 64-bit hash within one text only.  Columns of
    the same names are replaced.  A null text has no words and no lines.
    """
    given = [c for c in docs.columns if c not in MEASURES]
    body = docs.select(*[F.col(f"`{c}`") for c in given], F.coalesce("text", F.lit("")).alias("body"))
    closed = F.concat("body", F.lit("\n"))
    words = F.expr(_let(_WORDS, "w", f"struct(size(w) AS n, CASE WHEN size(w) < {WINDOW} THEN 0L ELSE {_REPEATED} END AS r, "
                          "CASE WHEN size(w) < 2 THEN 0 ELSE size(filter(sequence(1, size(w) - 1), i -> get(w, i) = get(w, i - 1))) END AS s)"))
    lines = F.expr(_let(f"filter(split(body, '\\n', -1), x -> btrim(x, {_BLANKS}) <> '')", "l", "struct(size(l) AS n, size(l) - size(array_distinct(l)) AS d)"))
    found = body.withColumns({"of_words": words, "of_lines": lines})
    return found.select(
        *[F.col(f"`{c}`") for c in given], F.col("of_words.n").cast("long").alias("n_words"),
        (F.length("body") - F.regexp_count("body", F.lit("[\\x20\\x09-\\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("of_lines.d").cast("long").alias("n_dup_lines"), F.col("of_words.r").cast("long").alias("n_repeat_words"),
        F.col("of_lines.n").cast("long").alias("n_lines"),
        F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("body", F.lit("!!")).cast("long").alias("n_shouts"),
        F.col("of_words.s").cast("long").alias("n_stutters"),
        F.regexp_count(closed, F.lit("[.!?][\\x20\\x09-\\x0D]")).cast("long").alias("n_ends"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    return [F.expr(rule).cast("int").alias(name) for name, rule in RULES.items()]


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> list[float]:
    """Accuracy of each rule, by expectation-maximisation.

    ``patterns`` counts the documents of each combination of votes: at most 3 to the
    number of rules, however large the corpus.  A rule's accuracy is the chance that a
    vote of it is right; neither class is favoured before the votes, or a rule that
    mostly votes alone would be talked out of its vote by the larger class.  Votes that
    others confirm make a rule more accurate, votes that others contradict less; the
    bounds keep every rule better than chance, which fixes which class is good.
    """
    accuracy = [START] * len(RULES)
    for _ in range(steps):
        right, cast = [0.0] * len(accuracy), [0.0] * len(accuracy)
        for pattern, count in patterns:
            p = posterior(pattern, accuracy)
            for j, vote in enumerate(pattern):
                if vote:
                    cast[j] += count
                    right[j] += count * (p if vote > 0 else 1 - p)
        accuracy = [min(max(r / c, LOWEST), HIGHEST) if c else a for r, c, a in zip(right, cast, accuracy)]
    return accuracy


def posterior(pattern: tuple[int, ...], accuracy: list[float]) -> float:
    odds = sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy))
    return 1 / (1 + math.exp(-odds))


def judged(measures: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``quality`` (posterior chance to be good), ``base_failed`` and ``kept``.

    ``measures`` should be a stored table: it is read once to count the votes and once
    to judge.  Documents that fail the base rule are out in any case and teach nothing.  The result is the same for any order of rows; equal rows get equal
    verdicts; a row without any vote has quality 0.5 and stays; an empty table stays empty.
    """
    counted = measures.where(~base_failed()).groupBy(*votes()).count().collect()
    accuracy = estimate(sorted((tuple(r)[:-1], r["count"]) for r in counted))
    odds = F.lit(0.0)
    for vote, a in zip(votes(), accuracy):
        odds = odds + vote * F.lit(math.log(a / (1 - a)))
    return (measures.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: id, measures, ``quality``, ``base_failed``, ``kept``."""
    return judged(saved(measured(docs.select("doc_id", "text")).drop("text")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    names = [f"`{c}`" for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("whole"), "text")
    judged_ = judged(saved(measured(whole).drop("text")))
    return judged_.where("kept").select("whole.*")
