"""Listening ratings: joins, sampling, blind assignment and the fit of score weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import lineage
from segue import refdata as R
from segue.functions import text
from segue.operators import ordered, resample
from segue.operators.mining import digest_number
from segue.operators.evaluate import CLASSIC_FACTORS, FACTORS, NEW_FACTORS

c = F.col
# fixed values
GOOD_FROM = 4
L2_STRENGTH = 1.0
DRAWS = 500
MAX_BUDGET = 0.30
FULL_COEFFICIENT = 1.0
EVENTS_PER_FEATURE = 10


# ------------------------------------------------------------------------- joins
def join_ratings(features: DataFrame, sheet: DataFrame) -> DataFrame:
    """Features with their rating and a status: ok, missing or invalid.

    ``sheet``: pair_id, rating (text).  A rating must round to 1..5; every
    factor must be a number.
    """
    notes = sheet.select(F.trim("pair_id").alias("pair_id"), F.trim(F.coalesce("rating", F.lit(""))).alias("note"))
    rows = features.withColumn("pair_id", F.trim("pair_id")).join(notes, "pair_id", "left")
    value = F.rint(c("note").try_cast("double")).cast("int")
    complete = F.lit(True)
    for f in FACTORS:
        complete = complete & c(f).isNotNull()
    status = (F.when(F.coalesce(c("note"), F.lit("")) == "", "missing")
              .when(F.coalesce(value.between(1, 5) & complete, F.lit(False)), "ok").otherwise("invalid"))
    return rows.withColumns({"status": status, "rating": F.when(status == "ok", value)}).drop("note")


def merge_ratings(sheet: DataFrame, new: DataFrame) -> DataFrame:
    """Replace ratings of known pairs; unknown pairs are never added."""
    fresh = new.select("pair_id", c("rating").alias("new_rating"), F.lit(True).alias("rated"))
    rows = sheet.join(fresh, "pair_id", "left")
    return rows.withColumn("rating", F.when(c("rated"), F.coalesce(c("new_rating").cast("string"), F.lit("")))
                           .otherwise(c("rating"))).drop("new_rating", "rated")


def unknown_ratings(sheet: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(sheet.select("pair_id"), "pair_id", "left_anti")


def review_list(sheet: DataFrame, features: DataFrame, tracks: DataFrame) -> DataFrame:
    """What a listener may see: clip, rating and track facts, but no factor values.

    ``features``: pair_id, crossfade, track_a, track_b (paths).  ``tracks``:
    file_path, bpm, genre, code.
    """
    paths = features.select("pair_id", "crossfade", "track_a", "track_b")

    def side(s: str) -> DataFrame:
        return tracks.select(F.lower("file_path").alias(f"path_{s}"), F.bround("bpm", 1).alias(f"bpm_{s}"),
                             c("genre").alias(f"genre_{s}"), c("code").alias(f"key_{s}"))

    rows = sheet.join(paths, "pair_id", "left").withColumns(
        {"path_a": F.lower("track_a"), "path_b": F.lower("track_b")})
    rows = rows.join(side("a"), "path_a", "left").join(side("b"), "path_b", "left")
    return rows.select("pair_id", "clip", "rating", "crossfade", text.basename(c("track_a")).alias("track_a"),
                       text.basename(c("track_b")).alias("track_b"), "bpm_a", "bpm_b", "genre_a", "genre_b", "key_a", "key_b")


# ---------------------------------------------------------------------- sampling
def maximin_sample(points: DataFrame, k: int, columns: Sequence[str] = FACTORS, key: str = "pair_id",
                   seed: int = 42, every: int = 20) -> DataFrame:
    """Farthest-point sample of k points: (key, round).

    Each round is one partial aggregate that returns a single row.  Distances to
    the points of the last rounds are expressions; every ``every`` rounds they
    are folded into a stored minimum and the lineage is cut.
    """
    spark = points.sparkSession
    rows = points.select(key, *[c(x).cast("double").alias(x) for x in columns])
    first = rows.orderBy(digest_number(F.lit(seed), c(key)), key).limit(1).collect()
    chosen = list(first)
    state = rows.withColumn("nearest", F.lit(float("inf")))
    recent = list(first)

    def distance(row) -> Column:
        total = F.lit(0.0)
        for x in columns:
            total = total + F.pow(c(x) - float(row[x]), F.lit(2.0))
        return F.when(c(key) == row[key], -1.0).otherwise(F.sqrt(total))   # -1: taken

    while len(chosen) < k and first:
        nearest = F.least(c("nearest"), *[distance(r) for r in recent])
        best = state.withColumn("d", nearest).where("d >= 0").agg(
            F.min_by(F.struct(key, *columns), F.struct((-c("d")).alias("back"), key)).alias("b")).collect()[0]["b"]
        if best is None:
            break
        chosen.append(best)
        recent.append(best)
        if len(recent) >= every:
            state = lineage.cut(state.withColumn("nearest", F.least(c("nearest"), *[distance(r) for r in recent])))
            recent = [best]
    schema = points.select(key).schema
    out = spark.createDataFrame([(r[key], i) for i, r in enumerate(chosen)],
                                f"{key} {schema[0].dataType.simpleString()}, round int")
    return out


def strided_sample(files: DataFrame, n: int, folder: str = "folder", path: str = "path") -> DataFrame:
    """n evenly spaced files per folder in path order; small folders whole.

    Paths are numbered in sampled ranges, so a huge folder is spread over tasks however
    its names begin.
    """
    sizes = files.groupBy(folder).agg(F.count("*").alias("size"))
    rows = ordered.attach(ordered.range_index(files, [folder], [path], "position"), sizes, folder, "position")
    step = c("size") / float(n)
    # position p is taken if it is floor(i * size / n) for some i
    i = F.ceil(c("position") / step)
    hit = (i < n) & (F.floor(i * step) == c("position"))
    return rows.where((c("size") <= n) | hit).drop("position", "size")


def blind_assignment(pairs: DataFrame, seed: int = 42, session: str = "session",
                     systems: tuple[str, str] = ("candidate", "baseline")) -> DataFrame:
    """Shuffle pairs and put the first system on side A for exactly half of them.

    Order and sides are two independent hash orders of the pair ids.
    """
    def shuffled(df: DataFrame, tag: int, name: str) -> DataFrame:
        keyed = df.withColumn("h", digest_number(F.lit(seed), F.lit(tag), c("pair_id")))
        return ordered.dense_index(keyed, [], ["h", "pair_id"], F.floor(c("h") / (2 ** 52)), name).drop("h")

    rows = shuffled(shuffled(pairs, 1, "place"), 2, "side_rank")
    rows = rows.withColumn("size", pairs.agg(F.count("*")).scalar())
    first_on_a = c("side_rank") < F.floor(c("size") / 2)
    label = F.lpad((c("place") + 1).cast("string"), 3, "0")
    return rows.select(F.lit(session).alias("session_id"), "pair_id", F.concat(F.lit("pair_"), label, F.lit("_A")).alias("candidate_a_id"),
                       F.concat(F.lit("pair_"), label, F.lit("_B")).alias("candidate_b_id"),
                       F.when(first_on_a, systems[0]).otherwise(systems[1]).alias("system_a"),
                       F.when(first_on_a, systems[1]).otherwise(systems[0]).alias("system_b"))


# --------------------------------------------------------------------------- fit
def design(rated: DataFrame, factors: Sequence[str] = FACTORS) -> DataFrame:
    """Target (good from 4) and z-scored factors; constant columns become 0."""
    rows = rated.where(c("rating").isNotNull())
    stats = rows.agg(F.struct(*[x for f in factors for x in (
        F.avg(f).alias(f"{f}_avg"), F.stddev_pop(f).alias(f"{f}_std"))]).alias("s")).scalar()
    joined = rows.withColumn("stats", stats)
    return joined.select("pair_id", (c("rating") >= GOOD_FROM).cast("double").alias("y"), *[
        F.when(c(f"stats.{f}_std") > 1e-12, (c(f) - c(f"stats.{f}_avg")) / c(f"stats.{f}_std")).otherwise(0.0).alias(f)
        for f in factors])


def fit_logistic(rows: DataFrame, factors: Sequence[str] = FACTORS, l2: float = L2_STRENGTH) -> DataFrame:
    """Coefficients of the L2-penalised logistic model, intercept free: (factor, coefficient)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = rows.count()
    data = VectorAssembler(inputCols=list(factors), outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="y", standardization=False, regParam=2.0 * l2 / n, elasticNetParam=0.0,
                               maxIter=500, tol=1e-12).fit(data)
    values = [("intercept", float(model.intercept)), *zip(factors, map(float, model.coefficients))]
    return rows.sparkSession.createDataFrame(values, "factor string, coefficient double")


def fit_gradient(rows: DataFrame, coefficients: DataFrame, factors: Sequence[str] = FACTORS, l2: float = L2_STRENGTH) -> DataFrame:
    """Mean gradient of the penalised loss at given coefficients: (factor, gradient), all 0 at the optimum."""
    names = ["intercept", *factors]
    beta = coefficients.agg(F.struct(*[F.max(F.when(c("factor") == f, c("coefficient"))).alias(f) for f in names]).alias("b")).scalar()
    score = c("beta.intercept")
    for f in factors:
        score = score + c("beta")[f] * c(f)
    placed = rows.withColumn("beta", beta).withColumn("miss", 1.0 / (1.0 + F.exp(-score)) - c("y"))
    sums = placed.agg(F.first("beta").alias("beta"), F.count("*").alias("n"), F.sum("miss").alias("g_intercept"), *[F.sum(c("miss") * c(f)).alias(f"g_{f}") for f in factors])
    entries = [F.struct(F.lit(f).alias("factor"), ((c(f"g_{f}") + (0.0 if f == "intercept" else c("beta")[f] * (2.0 * l2))) / c("n")).alias("gradient")) for f in names]
    return sums.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def _newton_sums(betas: np.ndarray, factors: Sequence[str], n: int, seed: int):
    """Per partition: gradient and curvature sums of every draw."""
    draws, k = betas.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros((draws, k)), np.zeros((draws, k, k))
        n_good, n_all = np.zeros(draws), np.zeros(draws)
        at, times = -1, np.zeros((draws, 0), dtype=np.int64)
        for pdf in batches:
            for block, part in pdf.groupby(pdf["row_idx"] // resample.BLOCK, sort=True):
                if block != at:
                    at, times = block, resample.multiplicities(int(block), n, draws, seed)
                x = np.column_stack([np.ones(len(part)), part[list(factors)].to_numpy(dtype=float)])
                y = part["y"].to_numpy(dtype=float)
                w = times[:, part["row_idx"].to_numpy() - block * resample.BLOCK].T.astype(float)
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ betas.T, -500.0, 500.0)))
                g += (w * (p - y[:, None])).T @ x
                h += ((w * p * (1.0 - p)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)).reshape(draws, k, k)
                n_good += (w * y[:, None]).sum(axis=0)
                n_all += w.sum(axis=0)
        yield pd.DataFrame({"draw": np.arange(draws), "g": list(g), "h": list(h.reshape(draws, k * k)),
                            "n_good": n_good, "n_all": n_all})
    return run


def bootstrap_draws(rows: DataFrame, factors: Sequence[str] = FACTORS, l2: float = L2_STRENGTH, draws: int = DRAWS,
                    seed: int = 42, steps: int = 200) -> np.ndarray:
    """Coefficients of every resample (draws x factors), Newton steps for all draws at once.

    Rows are numbered in an order that does not depend on partitions; how often each draw
    took a row follows from its number (see ``resample``), so rows carry no draws and no
    draw is shuffled.  One step is one pass: sums per partition, added up per draw; only
    draws x factors^2 numbers reach the driver.
    """
    keyed = rows.withColumn("h", digest_number(F.lit(seed), c("pair_id")))
    indexed = ordered.dense_index(keyed, [], ["h", "pair_id"], F.floor(c("h") / (2 ** 52)), "row_idx")
    data = lineage.stored(indexed.select("row_idx", "y", *factors).repartitionByRange("row_idx").sortWithinPartitions("row_idx"))
    n, k = data.count(), len(factors) + 1
    betas = np.zeros((draws, k))
    penalty = np.diag([0.0] + [2.0 * l2] * len(factors))
    schema = "draw int, g array<double>, h array<double>, n_good double, n_all double"
    usable = np.ones(draws, dtype=bool)
    for _ in range(steps):
        sums = data.mapInPandas(_newton_sums(betas, factors, n, seed), schema).groupBy("draw").agg(
            F.sum("n_good").alias("n_good"), F.sum("n_all").alias("n_all"),
            *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(k * k)]).toPandas().sort_values("draw")
        good, total = sums["n_good"].to_numpy(), sums["n_all"].to_numpy()
        usable = (good > 0) & (good < total)
        g = sums[[f"g{i}" for i in range(k)]].to_numpy() + betas @ penalty
        h = sums[[f"h{i}" for i in range(k * k)]].to_numpy().reshape(draws, k, k) + penalty + np.eye(k) * 1e-10
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        betas = betas - np.clip(step, -5.0, 5.0)
        if np.abs(step[usable]).max(initial=0.0) < 1e-8:
            break
    else:
        raise RuntimeError(f"{int((np.abs(step).max(axis=1) >= 1e-8).sum())} of {draws} draws do not converge in {steps} steps")
    return betas[usable, 1:]


def bootstrap_ci(rows: DataFrame, factors: Sequence[str] = FACTORS, l2: float = L2_STRENGTH, draws: int = DRAWS,
                 seed: int = 42) -> DataFrame:
    """95 % interval per coefficient; resamples with one class only are dropped."""
    sample = bootstrap_draws(rows, factors, l2, draws, seed)
    bounds = np.percentile(sample, [2.5, 97.5], axis=0) if len(sample) else np.zeros((2, len(factors)))
    return rows.sparkSession.createDataFrame(
        [(f, float(bounds[0, i]), float(bounds[1, i])) for i, f in enumerate(factors)], "factor string, lower double, upper double")


def data_verdict(rows: DataFrame, n_features: int) -> DataFrame:
    """Are there ten events per feature in both classes."""
    needed = EVENTS_PER_FEATURE * n_features
    out = rows.agg(F.sum(c("y").cast("long")).alias("n_good"), F.sum((1.0 - c("y")).cast("long")).alias("n_bad"))
    return out.select("n_good", "n_bad", F.lit(needed).alias("needed"),
                      ((c("n_good") >= needed) & (c("n_bad") >= needed)).alias("sufficient"))


def derive_weights(intervals: DataFrame, sufficient: bool = True, most: float = MAX_BUDGET) -> DataFrame:
    """Weights of the new factors from lower bounds that are safely above 0."""
    secured = (c("lower") > 0) & (c("upper") > 0)
    raw = F.when(F.lit(sufficient) & secured, c("lower")).otherwise(0.0)
    rows = intervals.where(c("factor").isin(*NEW_FACTORS)).withColumn("raw", raw)
    everything = Window.partitionBy(F.lit(1))   # four rows
    whole, best = F.sum("raw").over(everything), F.max("raw").over(everything)
    weight = F.when(whole > 0, F.least(F.lit(1.0), best / FULL_COEFFICIENT) * most * c("raw") / whole).otherwise(0.0)
    return rows.withColumn("weight", weight).select("factor", "weight")


def full_weights(new_weights: DataFrame) -> DataFrame:
    """Eight weights summing to 1: the classic factors share the rest in their usual ratio.

    The rounding remainder goes to the largest classic factor.
    """
    usual = {f: R.WEIGHT_DEFAULTS[f"{f}_weight"] for f in CLASSIC_FACTORS}
    total = sum(usual.values())
    wide = new_weights.agg(*[F.coalesce(F.bround(F.greatest(F.lit(0.0), F.max(F.when(c("factor") == f, c("weight")))), 6), F.lit(0.0))
                             .alias(f"{f}_weight") for f in NEW_FACTORS])
    rest = 1.0 - sum((c(f"{f}_weight") for f in NEW_FACTORS[1:]), c(f"{NEW_FACTORS[0]}_weight"))
    wide = wide.withColumn("rest", rest).withColumns({f"{f}_weight": F.bround(c("rest") * (usual[f] / total), 6) for f in CLASSIC_FACTORS})
    names = [f"{f}_weight" for f in FACTORS]
    gap = 1.0 - sum((c(n) for n in names[1:]), c(names[0]))
    largest = f"{max(CLASSIC_FACTORS, key=lambda f: usual[f])}_weight"
    return wide.withColumn(largest, F.bround(c(largest) + gap, 9)).select(*names)


def fit_report(rated: DataFrame, factors: Sequence[str] = FACTORS, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """Coefficients, intervals and weights with a JSON row per factor."""
    rows = design(rated, factors)
    verdict = data_verdict(rows, len(factors)).collect()[0]
    intervals = bootstrap_ci(rows, factors, draws=draws, seed=seed)
    weights = derive_weights(intervals, bool(verdict["sufficient"]))
    out = (intervals.join(fit_logistic(rows, factors), "factor").join(weights, "factor", "left")
           .withColumns({"n_good": F.lit(verdict["n_good"]), "n_bad": F.lit(verdict["n_bad"]),
                         "sufficient": F.lit(bool(verdict["sufficient"]))}))
    return out.withColumn("report", F.to_json(F.struct("factor", "coefficient", "lower", "upper", "weight", "sufficient")))


def genre_override(weights: DataFrame, genres: Sequence[str] = R.CANONICAL_GENRES) -> DataFrame:
    """One override row per genre for the weight lookup of pair scoring."""
    return weights.select(F.explode(R.array_column(list(genres))).alias("genre"), "*")
