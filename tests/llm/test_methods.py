"""Properties of the mix, the url cascade, the language and severity models, empty tables, the pipeline."""

import random

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segue.llm import decontaminate, langid, lines, mixing, quality, simhash, spans, toxicity, urls, warc


def test_apportion_matches_one_seat_at_a_time(spark):
    rng = random.Random(3)
    for n, seats in ((1, 5), (7, 3), (12, 200), (40, 41), (5, 0)):
        weights = [rng.choice([0, 1, 1, 2, 3, 50, 1000]) + rng.random() for _ in range(n)]
        if n > 5:
            weights[0] = 0.0
        table = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "k long, w double")
        got = {r["k"]: r["quota"] for r in mixing.apportion(table.withColumn("g", F.lit(1)), ["g"], "w", F.lit(seats), ["k"]).collect()}
        want = [0] * n
        for _ in range(seats):
            best = max(range(n), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == dict(enumerate(want))


def test_mix(make_docs, odd_rows):
    rows = [(d, t, None, [None, "b", "a", "é", "zz", ""][i % 6]) for i, (d, t) in enumerate(odd_rows)]
    got = mixing.mix(make_docs(rows), shard_words=500).toPandas()
    again = mixing.mix(make_docs(rows), shard_words=500).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert sorted(got["size"]) == sorted(len(brute.words(t)) for _, t, *_ in rows)
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by_source = got.groupby(got["source"].fillna("null")).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by_source["size"] == by_source["source_size"]).all()
    assert abs(by_source["target"].sum() - 1.5 * by_source["size"].sum()) < 1e-6
    assert ((by_source["taken"] - by_source["target"]).abs() <= 16 * (1 + by_source["size"] // 500) + 16).all()
    # targets: shares by weight in code point order (null last), resharing what is above twice the size
    names = sorted(n for n in by_source.index if n != "null") + ["null"]
    weight = {n: [3, 1, 2][i % 3] for i, n in enumerate(names)}
    capped, size = set(), by_source["size"].to_dict()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[n] for n in capped)
        level = left / sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and level * weight[n] > 2 * size[n]}
        if not over:
            break
        capped |= over
    for n in names:
        assert by_source["target"][n] == pytest.approx(2 * size[n] if n in capped else level * weight[n])


PAGES = [(1, "http://A.Example.org/es/x?y"), (2, "https://example.org/en/12#f"), (3, "http://org/"), (4, "http://x.org"), (5, "http://x.com/fr/1"),
         (6, "http://x.com/de/1"), (7, "http://bad.com/de/"), (8, "http://bad.com/de/2"), (9, "http://bad.com/en/2"), (10, None), (11, "no scheme/de/"),
         (12, "http://notexample.org/es/"), (13, "://com/de/?q://x"), (14, "http://É.COM/de/é"), (15, "http://x.com/fr"), (6, "http://x.com/de/1"), (None, "http://x.com/")]


def test_url_rules(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string").withColumn("html", F.lit("h")).withColumn("key", F.lit("k")).withColumn("host", F.lit("h"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judged(table).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("org", "/", "org/", "allow") and got[4] == ("x.org", "", None, "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[9][2:] == (None, "block")
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow") and got[12][2:] == ("org/", "allow")
    assert got[13] == ("com", "/de/", "com/de/", "block") and got[14] == ("É.com", "/de/é", "com/de/", "block") and got[15][2] is None
    assert urls.judged(table).count() == len(PAGES)


@pytest.mark.parametrize("listed, others", [(0, 50), (1, 0), (40, 3000), (500, 20)])
def test_cascade_is_exact(spark, listed, others):
    inside = spark.range(listed).select(F.concat(F.lit("in"), "id").alias("key"))
    universe = inside.unionByName(spark.range(others).select(F.concat(F.lit("out"), "id").alias("key")))
    cascade = urls.Cascade(inside.unionByName(inside), universe)
    wrong = universe.where(cascade.holds(F.col("key")) != F.startswith("key", F.lit("in"))).count()
    assert wrong == 0 and all(level.words * 8 <= max(64, 4 * (listed + others)) for level in cascade.levels)


def test_language(spark, sf, make_docs):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    found = langid.identified(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.97 and found["score"].between(0, 1).all()
    odd = make_docs([(1, None, "en"), (2, "12 !", "en"), (3, "the house and the garden", "en"), (None, "the", "de"), (4, "das haus und der garten", "de"),
                     (6, "x" * 300_000, None), (7, "", None), *[(100 + i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de") for i in range(12)]])
    got = {r["doc_id"]: r for r in langid.identified(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[7]["lang_pred"] == "und" and got[6]["lang_pred"] in ("en", "de")


def test_toxicity(spark, sf):
    base = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(base + "/documents.parquet"), spark.read.parquet(base + "/labels.parquet")
    train, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = toxicity.scored(docs, train).join(rest.withColumnRenamed("toxic", "label").drop("quality"), "doc_id").toPandas()
    clean, toxic = got[got["label"] == 0], got[got["label"] == 1]
    assert (clean["toxic"]).mean() < 0.02 and toxic["toxic"].mean() > 0.6
    assert toxic["severity"].mean() > clean["severity"].mean() + 0.5 and got["severity"].between(0, 2).all()


def test_ordinal_fit_recovers_order():
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(600)]
    truth = np.array([2.0, 1.0, 0.0, 0.0, -1.0, -2.0])
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=600)
    grades = np.digitize(score, [-1.0, 1.0])
    weights, thresholds = toxicity.fit(rows, grades, 6, 3)
    assert thresholds[0] < thresholds[1] and np.corrcoef(weights, truth)[0, 1] > 0.95


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(make_docs([(1, None), (2, "a"), (None, "b")]), none).collect()
    assert len(got) == 3 and not any(r["toxic"] for r in got)


def test_votes_agree_on_junk(make_docs, odd_rows):
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(make_docs(odd_rows)).collect()}
    assert not kept[60] and not kept[61] and not kept[62] and not kept[4] and kept[9]
    assert [f.name for f in quality.keep_good(make_docs(odd_rows)).schema] == make_docs(odd_rows).columns


def test_estimate_lowers_a_contradicted_rule():
    rule = lambda **v: tuple(v.get(n, 0) for n in quality.RULES)
    accuracy = dict(zip(quality.RULES, quality.estimate([(rule(prose=1), 900), (rule(symbols=-1, shouting=-1), 50), (rule(capitals=-1, prose=1), 30)])))
    assert accuracy["capitals"] < quality.START < accuracy["symbols"]


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (urls.judged(pages), langid.identified(docs), mixing.mix(docs), quality.verdicts(docs), warc.archived(pages), lines.digests(docs),
                   toxicity.scored(docs, labels), simhash.digests(docs), spans.digests(docs), decontaminate.digests(docs, bench)):
        assert result.count() == 0
    assert decontaminate.digests(make_docs([(1, "a b")]), bench).first()["n_hit"] == 0


def _expected(kept, bench):
    """What the stages after the quality rules leave of the rows that those kept."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    rank = lambda d: (d is not None, d or 0)
    keys = {}
    for d, t in kept:
        for line in (t or "").split("\n"):
            keys.setdefault(key(line), set()).add(d)
    gone = lambda d, line: len(key(line)) >= 40 and len(keys[key(line)]) >= 5 and d != max(keys[key(line)], key=rank)
    stage = [(d, "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in kept]
    stage = brute.survivors(stage, brute.jaccard_roots(stage))
    return [(d, t) for (d, t), r in zip(stage, brute.decontamination(stage, bench)) if not r[-1]]


def _written(spark, folder, rows, bench):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `new text` string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline(spark, tmp_path, odd_rows):
    """All stages against the plain versions, one after the other, with null, repeated and double ids."""
    rows = [(d, t, "en", f"s{i % 3}", len(t or ""), "x") for i, (d, t) in enumerate(odd_rows)]
    bench = [(1, " ".join(odd_rows[10][1].split()[1000:1015]))]
    docs = _written(spark, tmp_path, rows, bench)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas().astype({"doc_id": "Int64"})
    kept = [(r["doc_id"], r["text"]) for r in quality.keep_good(docs).collect()]
    ids = [None if d is pd.NA else int(d) for d in got["doc_id"]]
    assert sorted(zip(ids, got["size"]), key=str) == sorted(((d, len(brute.words(t))) for d, t in _expected(kept, bench)), key=str)
    assert (got["taken"] <= 2 * got["size"]).all() and len(corpus_pipeline.STAGES) == 5 and 9 not in set(ids)


@pytest.mark.parametrize("rows, bench", [([], []), ([], [(1, "a b")]), ([(1, " ".join(f"w{i}" for i in range(40)), None, None, None, None)], [])])
def test_pipeline_on_empty_tables(spark, tmp_path, rows, bench):
    _written(spark, tmp_path, rows, bench)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
