"""Learning weights from mined mixes: transitions, pair deltas, AUC, tolerances."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import lineage
from segue.functions import vectors
from segue.operators import ordered, resample, suppress

c = F.col

# fixed values: factor -> is a higher value better
DIRECTIONS = {"groove_sim": True, "sub_delta": False, "punch_delta": False, "brightness_delta": False, "timbre_sim": True}
MIN_NEGATIVES = 30
BLEND_HALF_SECONDS = 20.0
WINDOW_SECONDS = 30.0
MIN_GAP_SECONDS = 60.0
TRANSITION_Z = 2.5
HOLDOUT_MIN_AUC = 0.65
MAX_BUDGET = 0.30
MIN_GROUP = 30


# ------------------------------------------------------------ finding transitions
def find_transitions(frames: DataFrame, frame_seconds: float, threshold: float = TRANSITION_Z,
                     gap: float = MIN_GAP_SECONDS, block: int = 4096) -> DataFrame:
    """Timbre breaks of long mixes: (mix_id, transition_idx, t).

    ``frames``: mix_id, frame_idx, t_sec, mfcc[13].  The difference to the next
    frame is an equi-join, the moving mean a blockwise window; both split a
    long mix over tasks.
    """
    stats = frames.groupBy("mix_id").agg(
        F.max("t_sec").alias("length"),
        *[x for i in range(13) for x in (F.avg(F.get("mfcc", F.lit(i))).alias(f"m{i}"),
                                         F.stddev_pop(F.get("mfcc", F.lit(i))).alias(f"s{i}"))])
    info = stats.select("mix_id", "length", F.array(*[c(f"s{i}") + 1e-9 for i in range(13)]).alias("spread")) \
        .where(c("length") >= 2 * gap)
    nxt = frames.select("mix_id", (c("frame_idx") - 1).alias("frame_idx"), c("mfcc").alias("following"))
    steps = frames.select("mix_id", "frame_idx", "t_sec", "mfcc").join(nxt, ["mix_id", "frame_idx"])
    steps = ordered.attach(steps, info, "mix_id", "frame_idx")
    scaled = F.zip_with(F.zip_with("following", "mfcc", lambda x, y: x - y), "spread", lambda d, s: d / s)
    steps = steps.select("mix_id", "frame_idx", "t_sec", F.sqrt(vectors.dot(scaled, scaled)).alias("diff"))
    width = max(3, int(5.0 / frame_seconds))
    before, after = width // 2, (width - 1) // 2
    cut = ordered.blockwise(steps, "frame_idx", block, before, after)
    w = Window.partitionBy("mix_id", "block").orderBy("frame_idx").rowsBetween(-before, after)
    curve = cut.withColumn("novelty", F.sum("diff").over(w) / width).where(c("own")).select("mix_id", "frame_idx", "t_sec", "novelty")
    moments = curve.groupBy("mix_id").agg(F.avg("novelty").alias("mean"), F.stddev_pop("novelty").alias("std"))
    z = ordered.attach(curve, moments, "mix_id", "frame_idx").where(c("std") > 0) \
        .select("mix_id", "t_sec", ((c("novelty") - c("mean")) / c("std")).alias("z")).where(c("z") >= threshold)
    taken = suppress.strongest_apart(z.withColumn("gap", F.lit(float(gap))), "mix_id", "t_sec", "gap", ["z", "t_sec"])
    taken = ordered.dense_index(taken.select("mix_id", "t_sec"), ["mix_id"], ["t_sec"], F.floor(c("t_sec") / (gap * 4096)), "transition_idx")
    return taken.select("mix_id", c("transition_idx").cast("int").alias("transition_idx"), c("t_sec").alias("t"))


def window_bounds(transitions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stable windows before and after each transition; dropped where one is cut off."""
    rows = transitions.join(lengths, "mix_id").where(
        (c("t") - BLEND_HALF_SECONDS - WINDOW_SECONDS >= 0) & (c("t") + BLEND_HALF_SECONDS + WINDOW_SECONDS <= c("length")))
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), (c("t") - BLEND_HALF_SECONDS - WINDOW_SECONDS).alias("start_s")),
        F.struct(F.lit(1).alias("side"), (c("t") + BLEND_HALF_SECONDS).alias("start_s"))))
    return rows.select("mix_id", "transition_idx", sides.alias("w")).select(
        "mix_id", "transition_idx", "w.side", "w.start_s", (c("w.start_s") + WINDOW_SECONDS).alias("end_s"))


def second_profile(frames: DataFrame) -> DataFrame:
    """Band levels and onset density per second, relative to the median second of the mix."""
    per_second = frames.groupBy("mix_id", F.floor("t_sec").alias("second")).agg(
        *[F.sqrt(F.avg(f"{b}_ms")).alias(b) for b in ("bass", "mids", "highs")], F.avg("onset").alias("onset"))
    per_second, names = lineage.stored(per_second), ("bass", "mids", "highs", "onset")
    middle = ordered.group_quantiles(per_second, "mix_id", {n: {f"{n}_mid": 0.5} for n in names}, "second")
    medians = middle.select("mix_id", *[(c(f"{n}_mid") + 1e-9).alias(f"{n}_ref") for n in names])
    return ordered.attach(per_second, medians, "mix_id", "second").select(
        "mix_id", "second", *[(c(n) / c(f"{n}_ref")).alias(n) for n in names])


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0


def band_at_centre(level: Column) -> Column:
    """Mean level of the centre seven seconds over the median of the surroundings."""
    mid = (F.size(level) / 2).cast("int")
    around = F.concat(F.slice(level, mid - 44, 25), F.slice(level, mid + 21, 25))
    centre = F.aggregate(F.slice(level, mid - 2, 7), F.lit(0.0), lambda acc, v: acc + v) / 7.0
    return centre / (_median(around) + 1e-9)


def blend_width(onset: Column) -> Column:
    """Seconds of raised onset density around the centre, 0 if it is not raised there.

    The reference level is zipped in once per row; inside a lambda it would be
    recomputed for every second.
    """
    n = F.size(onset)
    mid = (n / 2).cast("int")
    base = _median(F.concat(F.slice(onset, F.lit(1), F.lit(15)), F.slice(onset, n - 14, F.lit(15)))) * 1.10
    low = F.zip_with(F.zip_with(onset, F.array_repeat(base, n), lambda v, b: v <= b), F.sequence(F.lit(0), n - 1),
                     lambda is_low, i: F.when(is_low, i))
    near = F.exists(F.slice(low, mid, 3), lambda i: i.isNull())
    left = F.array_max(F.filter(low, lambda i: i < mid))
    right = F.array_min(F.filter(low, lambda i: i > mid))
    width = F.coalesce(right, n) - F.coalesce(left, F.lit(-1)) - 1
    return F.when(near, width.cast("double")).otherwise(0.0)


def _blend_spots(windows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Size and median blend of each length group; mids at the centre and at the edge of the blend per transition."""
    width = F.when(c("width") <= 8, "kurz").when(c("width") <= 25, "mittel").otherwise("lang")
    rows = windows.select(*keep, "mids", blend_width(c("onset")).alias("width"))
    rows = lineage.stored(rows.withColumn("grp", width))   # read by sizes, quantiles and spots
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    typical = ordered.quantiles(rows.select("grp", "width"), ["grp"], "width", {"blend_s": 0.5})
    groups = sizes.join(typical, "grp").withColumn("sufficient", c("n") >= MIN_GROUP)
    mid = (F.size("mids") / 2).cast("int")
    around = _median(F.concat(F.slice("mids", mid - 44, 25), F.slice("mids", mid + 21, 25))) + 1e-9
    radius = F.greatest(F.lit(1), F.least(F.rint(c("blend_s") / 2.0).cast("int"), mid - 1))
    spots = rows.join(F.broadcast(groups), "grp").select("grp", "n", *keep, (F.get("mids", mid) / around).alias("centre"),   # three groups at most
                                            (F.get("mids", mid + radius) / around).alias("edge"))
    return groups, spots


def blend_report(windows: DataFrame) -> DataFrame:
    """Transitions, median blend and dip depth per blend-length group.

    ``windows``: onset and mids arrays, one row per transition.  ``sufficient`` tells
    whether a group has at least 30 transitions.
    """
    groups, spots = _blend_spots(windows, [])
    both = lineage.stored(spots).select("grp", F.explode(F.array(
        F.struct(F.lit("centre").alias("spot"), c("centre").alias("v")),
        F.struct(F.lit("edge").alias("spot"), c("edge").alias("v")))).alias("x")).select("grp", "x.*")
    medians = ordered.quantiles(both, ["grp", "spot"], "v", {"m": 0.5})
    depth = medians.groupBy("grp").agg((1.0 - F.max(F.when(c("spot") == "centre", c("m")))
                                        / F.max(F.when(c("spot") == "edge", c("m")))).alias("dip_depth"))
    return groups.join(depth, "grp")


SPOTS, DRAW_CHUNK, DIP_DRAWS, DIP_SEED = ("centre", "edge"), 50, 1000, 7


def _picked_near_median(draws: int, seed: int):
    """How often each draw takes the rows near the median, and how many picks lie below them."""
    schema = ["grp", "spot", "chunk", "n", "value", "times"]

    def run(batches):
        for batch in batches:
            out = []
            for (grp, block), rows in batch.groupby(["grp", batch["row_idx"] // resample.BLOCK], sort=False):
                n = int(rows["n"].iloc[0])
                times = resample.multiplicities(int(block), n, draws, seed)[:, rows["row_idx"].to_numpy() - int(block) * resample.BLOCK]
                for spot in SPOTS:
                    v, low, high = (rows[x].to_numpy() for x in (spot, f"{spot}_from", f"{spot}_to"))
                    parts = [(None, times[:, v < low].sum(axis=1))] + [(float(v[i]), times[:, i]) for i in np.flatnonzero((v >= low) & (v <= high))]
                    out += [(grp, spot, at // DRAW_CHUNK, n, value, counts[at:at + DRAW_CHUNK]) for value, counts in parts
                            for at in range(0, draws, DRAW_CHUNK)]
            yield pd.DataFrame(out, columns=schema)
    return run


def _drawn_medians(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians of a chunk of draws from the picks near the median, in value order."""
    inside = rows[rows["value"].notna()].sort_values("value")
    below = np.sum(list(rows.loc[rows["value"].isna(), "times"]), axis=0)
    until = below + np.cumsum(np.array(list(inside["times"])).reshape(len(inside), len(below)), axis=0)
    values, n = inside["value"].to_numpy(), int(rows["n"].iloc[0])
    ranks = [(n - 1) // 2, n // 2]
    if not len(values) or (below > ranks[0]).any() or (until[-1] <= ranks[1]).any():
        raise ValueError("median of a draw outside its bracket")
    median = sum(values[(until <= rank).sum(axis=0)] for rank in ranks) / 2.0
    first = int(rows["chunk"].iloc[0]) * DRAW_CHUNK
    return pd.DataFrame({"grp": rows["grp"].iloc[0], "spot": rows["spot"].iloc[0], "draw": first + np.arange(len(median)), "m": median})


def dip_ranges(windows: DataFrame, key: str, draws: int = DIP_DRAWS, seed: int = DIP_SEED) -> DataFrame:
    """95 % range of the dip depth per blend-length group, by resampling transitions: grp, lower, upper, carries.

    ``windows`` as in :func:`blend_report`, told apart by the integer column ``key``.  A draw's
    median lies within a few root-n ranks of the group's, so rows outside a bracket of seven standard
    deviations are only counted; about root-n rows a group leave their task, with their
    picks for ``DRAW_CHUNK`` draws at a time.  A bracket that missed would be an error.  Groups of one
    transition and values that are not finite have no range; ``carries`` tells whether 0 lies below it.
    """
    _, spots = _blend_spots(windows, [key])
    keyed = spots.drop("n").where("isnotnull(centre) AND isnotnull(edge) AND NOT isnan(centre) AND NOT isnan(edge)").withColumn(
        "h", digest_number(F.lit(seed), c(key)))
    placed = lineage.stored(ordered.dense_index(keyed, ["grp"], ["h", key, "centre", "edge"], F.floor(c("h") / (2 ** 52)), "row_idx"))
    sketch = F.lit(10_000)
    ranges = []
    for row in placed.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").orderBy("grp").collect():   # at most three groups
        reach = 3.5 / row["n"] ** 0.5 + 2e-4
        ends = F.array(F.lit(max(0.0, 0.5 - reach)), F.lit(min(1.0, 0.5 + reach)))
        found = [F.percentile_approx(x, ends, sketch).alias(x) for x in SPOTS]
        ranges.append(placed.where(c("grp") == row["grp"]).agg(*found).select(
            F.lit(row["grp"]).alias("grp"), F.lit(row["n"]).alias("n"), *[F.get(x, F.lit(i)).alias(f"{x}_{end}") for x in SPOTS
                                                                         for i, end in enumerate(("from", "to"))]))
    if not ranges:
        return placed.select("grp", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
                             F.lit(None).cast("boolean").alias("carries")).distinct()
    data = placed.join(F.broadcast(reduce(DataFrame.unionByName, ranges)), "grp").repartitionByRange("grp", "row_idx").sortWithinPartitions("grp", "row_idx")
    picks = data.mapInPandas(_picked_near_median(draws, seed), "grp string, spot string, chunk int, n long, value double, times array<long>")
    medians = picks.groupBy("grp", "spot", "chunk").applyInPandas(_drawn_medians, "grp string, spot string, draw int, m double")
    depths = medians.groupBy("grp", "draw").agg((1.0 - F.max(F.when(c("spot") == "centre", c("m")))
                                                 / F.max(F.when(c("spot") == "edge", c("m")))).alias("depth"))
    bounds = depths.groupBy("grp").agg(F.percentile("depth", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))   # one row a draw
    return (placed.select("grp").distinct().join(bounds, "grp", "left")
            .select("grp", F.get("b", F.lit(0)).alias("lower"), F.get("b", F.lit(1)).alias("upper"), (F.get("b", F.lit(0)) > 0).alias("carries")))


# ------------------------------------------------------------------- pair deltas
def _deltas(a: str, b: str) -> list[Column]:
    def side(s: str, name: str) -> Column:
        return c(f"{s}_{name}")

    groove = F.coalesce(vectors.cyclic_cosine(side(a, "bass_pattern"), side(b, "bass_pattern")),
                        vectors.cyclic_cosine(side(a, "groove_pattern"), side(b, "groove_pattern")), F.lit(0.0))
    return [groove.alias("groove_sim"),
            F.abs(side(a, "sub_energy") - side(b, "sub_energy")).alias("sub_delta"),
            F.abs(side(a, "bass_punch") - side(b, "bass_punch")).alias("punch_delta"),
            F.abs(side(a, "brightness") - side(b, "brightness")).alias("brightness_delta"),
            F.coalesce(vectors.cosine(side(a, "timbre"), side(b, "timbre")), F.lit(0.0)).alias("timbre_sim")]


MEASURES = ("groove_pattern", "bass_pattern", "sub_energy", "bass_punch", "brightness", "timbre")


def _side(windows: DataFrame, prefix: str, index: str) -> DataFrame:
    return windows.select("mix_id", c("window_idx").alias(index), *[c(m).alias(f"{prefix}_{m}") for m in MEASURES])


def with_window_index(windows: DataFrame) -> DataFrame:
    return windows.withColumn("window_idx", c("transition_idx") * 2 + c("side"))


def true_deltas(windows: DataFrame) -> DataFrame:
    """Deltas between the windows before and after each transition."""
    w = with_window_index(windows)
    before = _side(w.where("side = 0"), "x", "i")
    after = _side(w.where("side = 1"), "y", "j").withColumn("i", c("j") - 1)
    return before.join(after, ["mix_id", "i"]).select("mix_id", "i", "j", *_deltas("x", "y"))


def digest_number(*parts: Column) -> Column:
    """60 bits of an MD5 digest: a draw that every engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


WALK = 2_147_483_647   # a prime step: a walk with it through fewer pairs meets none twice


def _numbered(windows: DataFrame) -> DataFrame:
    """Windows with their place 0, 1, 2, ... in the mix; numbers may have gaps."""
    w = with_window_index(windows)
    return ordered.dense_index(w, ["mix_id"], ["window_idx"], F.floor(c("window_idx") / 4096), "place")


def _negative_places(placed: DataFrame, seed: int) -> DataFrame:
    """(mix_id, a, b): places of the chosen pairs.

    Pairs a < b are numbered b (b - 1) / 2 + a.  From a digest-chosen start a walk with
    a prime step visits pair numbers without repeats; at most one pair a transition is
    a true one, so so many more steps than wanted always suffice: nothing is tried again
    and no pair is missing as long as there are enough.
    """
    true = placed.groupBy("mix_id", "transition_idx").agg((F.count("*") > 1).cast("long").alias("both"), F.count("*").alias("k"),
                                                          F.count_if(c("side") == 0).alias("before"))
    mixes = true.groupBy("mix_id").agg(F.sum("k").alias("n"), F.sum("both").alias("same"), F.sum("before").alias("n_true"))
    mixes = mixes.where(c("n") >= 2).withColumns({
        "wanted": F.greatest(F.lit(MIN_NEGATIVES), c("n_true")), "all": F.expr("n * (n - 1) div 2")})
    steps = mixes.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(c("wanted") + c("same"), c("all")) - 1)))
    number = F.pmod(digest_number(F.lit(seed), c("mix_id")) % c("all") + c("step") * F.lit(WALK) % c("all"), c("all"))
    b = F.floor((1.0 + F.sqrt(1.0 + 8.0 * c("number"))) / 2.0)
    return (steps.withColumn("number", number).withColumn("b", b.cast("long"))
            .withColumn("a", c("number") - F.expr("b * (b - 1) div 2")).select("mix_id", "wanted", "step", "a", "b"))


def negative_pairs(windows: DataFrame, seed: int = 42) -> DataFrame:
    """Random window pairs of a mix that are no transition: (mix_id, i, j), as many as wanted or as there are."""
    return _chosen_pairs(_numbered(windows), seed).select("mix_id", c("x_idx").alias("i"), c("y_idx").alias("j"))


def _chosen_pairs(placed: DataFrame, seed: int) -> DataFrame:
    def side(prefix: str, place: str) -> DataFrame:
        return placed.select("mix_id", c("place").alias(place), c("window_idx").alias(f"{prefix}_idx"), c("transition_idx").alias(f"{prefix}_of"),
                             *[c(m).alias(f"{prefix}_{m}") for m in MEASURES])

    pairs = _negative_places(placed, seed).join(side("x", "a"), ["mix_id", "a"]).join(side("y", "b"), ["mix_id", "b"])
    order = Window.partitionBy("mix_id").orderBy("step")
    return (pairs.where(c("x_of") != c("y_of")).withColumn("rank", F.row_number().over(order)).where(c("rank") <= c("wanted")))


def negative_deltas(windows: DataFrame, seed: int = 42) -> DataFrame:
    return _chosen_pairs(_numbered(windows), seed).select("mix_id", c("x_idx").alias("i"), c("y_idx").alias("j"), *_deltas("x", "y"))


def mix_deltas(windows: DataFrame, seed: int = 42) -> DataFrame:
    """True and random pairs with a ``positive`` flag."""
    return (true_deltas(windows).withColumn("positive", F.lit(True))
            .unionByName(negative_deltas(windows, seed).withColumn("positive", F.lit(False))))


def long_deltas(deltas: DataFrame) -> DataFrame:
    """(mix_id, factor, value, positive) with values oriented so that higher is better."""
    entries = [F.struct(F.lit(f).alias("factor"), (c(f) if up else -c(f)).alias("value")) for f, up in DIRECTIONS.items()]
    return deltas.select("mix_id", "positive", F.explode(F.array(*entries)).alias("x")).select("mix_id", "positive", "x.*")


# --------------------------------------------------------------------------- AUC
def auc(scores: DataFrame, keys: list[str], value: str = "value", label: str = "positive") -> DataFrame:
    """Share of correctly ordered (positive, negative) pairs, ties counted half.

    A rank sum over running counts of distinct values: no pairs are formed and
    no group is sorted in one task.  A group without one of the classes gets 0.5.
    """
    rows = scores.select(*keys, value, c(label).cast("long").alias("pos"), (~c(label)).cast("long").alias("neg"))
    placed = ordered.running_totals(rows, keys, value, ["pos", "neg"])
    won = F.sum(c("pos") * (c("below_neg") + c("neg") / 2.0))
    agg = placed.groupBy(*keys).agg(won.alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*keys, "n_pos", "n_neg", F.coalesce(
        c("won") / F.nullif(c("n_pos") * c("n_neg"), F.lit(0)), F.lit(0.5)).alias("auc"))


TILE, DRAW_BLOCK = 256, 1000   # clusters of a tile; draws that one task adds up at most
HELD, SHARD_ROWS, PICKS = 1 << 24, 500_000, 1 << 18   # counts of draws that a task of the rank sums holds, rows that it reads; picks that a task draws


def _counted_picks(n: int, size: int):
    """Picks in the order of their draws, counted by cluster: a row a tile."""
    def rows(draw: int, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        side, cluster = at // n, at % n
        tile = cluster // size
        starts = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (tile[1:] != tile[:-1])])
        offsets = pa.array(np.r_[starts, len(at)], pa.int32())
        return pa.record_batch([pa.array(np.full(len(starts), draw), pa.int32()), pa.array(side[starts], pa.int32()), pa.array(tile[starts], pa.int32()),
                                pa.ListArray.from_arrays(offsets, pa.array(cluster, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts[at], pa.int32()))],
                               names=["draw", "side", "tile", "clusters", "times"])

    def run(batches):
        current, counts = None, None
        for batch in batches:
            draw, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, draw[1:] != draw[:-1]][:len(draw)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(draw)]):
                if draw[s] != current:
                    if current is not None:
                        yield rows(current, counts)
                    current, counts = draw[s], np.zeros(2 * n, dtype=np.int64)
                counts += np.bincount(at[s:e], minlength=2 * n)
        if current is not None:
            yield rows(current, counts)
    return run


def _draws(clusters: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, side, tile, clusters, times): how often a draw took which clusters of a tile; side 0 for positives, 1 for negatives.

    Positives and negatives draw their clusters independently, with replacement.  Tasks
    count the picks of whole draws; a draw that two tasks share has rows of both, which add up.
    """
    n = clusters.count()
    picks = clusters.sparkSession.range(0, draws * n * 2, 1, max(1, -(-draws * n * 2 // PICKS))).select(
        F.floor(c("id") / (2 * n)).cast("int").alias("draw"),
        (c("id") % 2 * n + F.pmod(digest_number(F.lit(seed), c("id")), F.lit(n))).alias("at"))
    return picks.mapInArrow(_counted_picks(n, TILE), "draw int, side int, tile int, clusters array<int>, times array<int>")


def _inside(key: str):
    """Concordance inside one range of values: positives of a tile of clusters against all negatives of the range."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.unique(pdf.loc[pdf["pos"] > 0, "cluster_idx"]), np.unique(pdf.loc[pdf["neg"] > 0, "cluster_idx"])
        found, run_ = np.zeros((len(rows), len(columns))), np.zeros(len(columns))
        for _, same in pdf.groupby("value", sort=True):
            p, q = same[same["pos"] > 0], same[same["neg"] > 0]
            here = np.zeros(len(columns))
            np.add.at(here, np.searchsorted(columns, q["cluster_idx"]), q["neg"])
            if len(p):
                np.add.at(found, np.searchsorted(rows, p["cluster_idx"]), p["pos"].to_numpy(float)[:, None] * (run_ + here / 2.0))
            run_ += here
        i, j = np.nonzero(found)
        return pd.DataFrame({key: pdf[key].iloc[0], "i": rows[i], "j": columns[j], "x": found[i, j]})
    return run


def concordance_tiles(scores: DataFrame, key: str, cluster: str, clusters: DataFrame) -> DataFrame:
    """(key, i, tile, won): how often positives of cluster i win against negatives of the clusters of a tile, ties counted half.

    ``clusters``: cluster, cluster_idx.  ``won`` has one entry a cluster of the tile; row -1 of a key
    holds their negatives, ``n_pos`` the positives of cluster i.  Values are dealt to
    ranges; pairs inside a range are counted there, pairs across ranges follow from the
    counts per cluster and range.  The matrix has clusters^2 entries and is formed in tiles.
    """
    n = clusters.count()
    counts = (scores.join(clusters, cluster).groupBy(key, "value", "cluster_idx")
              .agg(F.count_if("positive").alias("pos"), F.count_if(~c("positive")).alias("neg")))
    ranged = lineage.stored(counts.repartitionByRange(key, "value").withColumn("part", F.spark_partition_id()))
    tiles = F.sequence(F.lit(0), F.lit((n - 1) // TILE))
    tile = F.floor(c("cluster_idx") / TILE).cast("int")
    zero = F.lit(0).cast("long")
    own = ranged.where("pos > 0").select(key, "part", tile.alias("tile"), "value", "cluster_idx", "pos", zero.alias("neg"))
    others = ranged.where("neg > 0").select(key, "part", F.explode(tiles).alias("tile"), "value", "cluster_idx", zero.alias("pos"), "neg")
    inside = own.unionByName(others).groupBy(key, "part", "tile").applyInPandas(_inside(key), f"{key} string, i long, j long, x double")
    inside = inside.groupBy(key, "i", "j").agg(F.sum("x").alias("x"))
    totals = ranged.groupBy(key, "part", "cluster_idx").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    def entry(rows: DataFrame, kind: int, row: Column, column: Column, a: str, b: str, x: str) -> DataFrame:
        placed = rows.select("*", row.alias("row_tile")).select("*", column.alias("tile"))
        return placed.select(key, "row_tile", "tile", F.lit(kind).alias("kind"), c(a).cast("long").alias("a"), c(b).cast("long").alias("b"), c(x).cast("double").alias("x"))

    every = F.explode(tiles)
    rows = (entry(inside, 0, F.floor(c("i") / TILE).cast("int"), F.floor(c("j") / TILE).cast("int"), "i", "j", "x")
            .unionByName(entry(totals.where("pos > 0"), 1, tile, every, "part", "cluster_idx", "pos"))
            .unionByName(entry(totals.where("neg > 0"), 2, every, tile, "part", "cluster_idx", "neg")))

    def tiled(pdf: pd.DataFrame) -> pd.DataFrame:
        (row, size), (column, width) = ((first, min(TILE, n - first)) for first in (int(pdf[t].iloc[0]) * TILE for t in ("row_tile", "tile")))
        part = {k: i for i, k in enumerate(sorted(set(pdf.loc[pdf["kind"].isin([1, 2]), "a"])))}
        won, pos, neg = np.zeros((size, width)), np.zeros((len(part), size)), np.zeros((len(part), width))
        for kind, same in pdf.groupby("kind"):
            a, b, x = same["a"].to_numpy(), same["b"].to_numpy(), same["x"].to_numpy()
            if kind == 0:
                won[a - row, b - column] += x
            elif kind == 1:
                pos[[part[k] for k in a], b - row] = x
            else:
                neg[[part[k] for k in a], b - column] = x
        won += pos.T @ (neg.cumsum(axis=0) - neg)     # ranges are numbered in order of their values
        index = list(range(row, row + size)) + ([-1] if row == 0 else [])
        return pd.DataFrame({key: pdf[key].iloc[0], "i": index, "tile": column // TILE, "n_pos": [*pos.sum(axis=0), *([0.0] if row == 0 else [])],
                             "won": [*won, *([neg.sum(axis=0)] if row == 0 else [])]})

    return rows.groupBy(key, "row_tile", "tile").applyInPandas(tiled, f"{key} string, i long, tile int, n_pos double, won array<double>")


def concordance(scores: DataFrame, key: str, cluster: str, clusters: DataFrame) -> DataFrame:
    """The rows of :func:`concordance_tiles` put together: ``won`` has one entry a cluster."""
    n = clusters.count()
    parts = concordance_tiles(scores, key, cluster, clusters).groupBy(key, "i").agg(
        F.max("n_pos").alias("n_pos"), F.map_from_entries(F.collect_list(F.struct("tile", "won"))).alias("parts"))   # one entry a tile
    empty = F.array_repeat(F.lit(0.0), TILE)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit((n - 1) // TILE)), lambda t: F.coalesce(F.element_at(c("parts"), t), empty)))
    return parts.select(key, "i", "n_pos", F.slice(whole, 1, n).alias("won"))


def _packed(batches):
    """Rows sorted by key, value and class in packed runs of a key: clusters, counts, and marks (1 for positives, 2 more where a value begins, 4 more without one)."""
    held, seq = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        name, value = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).fill_null(np.nan).to_numpy()
        missing = np.isnan(value)
        value = np.where(missing, 0.0, value)
        before = [np.r_[x[:1] if held is None else h, x[:-1]] for h, x in zip(held or [None] * 3, (name, missing, value))]
        other = name != before[0]
        fresh = other | (missing != before[1]) | (value != before[2])
        fresh[0] |= held is None
        held = [name[-1:], missing[-1:], value[-1:]]
        marks = batch.column(3).to_numpy(zero_copy_only=False) + 2 * fresh + 4 * missing
        clusters, counts = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        starts = np.flatnonzero(np.r_[True, other[1:]])
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(name)]))
        yield pa.record_batch([pa.array([batch.column(0)[0].as_py()] * len(spans), pa.int32()), pa.array(range(seq, seq + len(spans)), pa.int32()),
                               pa.array([name[s] for s, _ in spans], pa.string()),
                               *[pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (clusters, counts, marks.astype(np.uint8))]],
                              names=["shard", "seq", "name", "at", "k", "marks"])
        seq += len(spans)


def _rank_sums(n: int, draws: int, block: int, shards: int):
    """For the rows of a shard and a block of draws: won pairs and both sizes of every draw.

    Rows come in the order of their values, so a draw's negatives below a positive are one
    running sum; a task holds the counts of its draws, rows pass through.  Rows without a
    value (null, NaN) add to the sizes, but win and lose nothing.
    """
    kind = np.uint16 if n < 1 << 16 else np.uint32      # no count is above n

    def drawn(times: np.ndarray, rows: pa.RecordBatch, first: int) -> None:
        lists = rows.column("clusters")
        lengths = np.diff(lists.offsets.to_numpy())
        draw, side = (np.repeat(rows.column(x).to_numpy(), lengths).astype(np.int64) for x in ("draw", "side"))
        np.add.at(times.reshape(-1), (side * n + lists.flatten().to_numpy()) * times.shape[2] + draw - first, rows.column("times").flatten().to_numpy().astype(kind))

    def taken(times: np.ndarray, clusters: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(clusters) == 1:
            return times[clusters[0]] * float(counts[0])
        return sum(counts[s:s + 512].astype(float) @ times[clusters[s:s + 512]] for s in range(0, len(clusters), 512))

    def run(batches):
        cell, name, times, state = None, None, None, None

        def result() -> pa.RecordBatch:
            size = times.shape[2]
            return pa.record_batch([pa.array([name] * size, pa.string()), pa.array([cell % shards] * size, pa.int32()),
                                    pa.array(range(cell // shards * block, cell // shards * block + size), pa.int32()),
                                    *[pa.array(x) for x in state[:5]]], names=["name", "shard", "draw", "won", "pos", "neg", "no_pos", "no_neg"])

        for batch in batches:
            where = batch.column("cell").to_numpy()
            for here in np.unique(where):
                rows = batch.filter(pa.array(where == here))
                if here != cell:
                    if state is not None:
                        yield result()
                    cell, state = int(here), None
                    times = np.zeros((2, n, min(block, draws - cell // shards * block)), dtype=kind)
                packed = rows.column("seq").to_numpy() >= 0      # after all the draws of the cell
                drawn(times, rows.filter(pa.array(~packed)), cell // shards * block)
                for who, *parts in zip(*(rows.filter(pa.array(packed)).column(x).to_pylist() for x in ("name", "at", "k", "marks"))):
                    if state is None or who != name:
                        if state is not None:
                            yield result()
                        name, state = who, [*np.zeros((5, times.shape[2])), None]
                    won, have, below, *without, tie = state
                    clusters, counts, marks = (np.frombuffer(x, dtype=d) for x, d in zip(parts, (np.int64, np.int64, np.uint8)))
                    starts = np.flatnonzero(np.r_[True, (marks[1:] & 2 > 0) | (marks[1:] % 2 != marks[:-1] % 2)])
                    for s, e, mark in zip(starts.tolist(), [*starts[1:].tolist(), len(marks)], marks[starts].tolist()):
                        x = taken(times[1 - mark % 2], clusters[s:e], counts[s:e])
                        if mark & 4:
                            without[1 - mark % 2] += x
                            continue
                        if mark & 2:
                            tie = None                              # the negatives of this value, which come first
                        if mark % 2:
                            won += x * (below if tie is None else below - tie / 2.0)
                            have += x
                        else:
                            below += x
                            tie = x if tie is None else tie + x
                    state[5] = tie
        if state is not None:
            yield result()
    return run


def auc_interval(scores: DataFrame, key: str = "factor", cluster: str = "mix_id", draws: int = 2000, seed: int = 42) -> DataFrame:
    """AUC with a 95 % interval from resampling whole clusters (mixes).

    A draw's AUC is a rank sum of the rows weighed by how often it took their clusters.
    Rows are counted per value, class and cluster and dealt to shards by value; a task
    adds up one shard for a block of draws, of which it holds the counts.  Shards are put
    together by their totals.  Costs rows x draws; rows never carry draws, no pairs of
    clusters are formed.
    """
    base = scores.select(cluster).distinct().withColumn("h", digest_number(c(cluster)))
    base = lineage.stored(ordered.dense_index(base, [], ["h", cluster], F.floor(c("h") / (2 ** 52)), "cluster_idx").drop("h"))
    n = base.count()
    rows = lineage.stored(scores.where(c("positive").isNotNull()).join(base, cluster)
                          .groupBy(c(key).alias("name"), c("value").cast("double").alias("value"), "positive", "cluster_idx").agg(F.count("*").alias("k")))
    packed = (rows.repartitionByRange(max(1, -(-rows.count() // SHARD_ROWS)), "name", "value").withColumn("shard", F.spark_partition_id())
              .sortWithinPartitions("name", "value", "positive").select("shard", "name", "value", "positive", "cluster_idx", "k")
              .mapInArrow(_packed, "shard int, seq int, name string, at binary, k binary, marks binary"))
    packed = lineage.stored(packed)   # a session may deal to more ranges than asked
    shards = packed.agg(F.coalesce(F.max("shard"), F.lit(0)) + 1).first()[0]
    blocks = -(-draws // max(1, min(DRAW_BLOCK, HELD // (2 * max(n, 1)))))
    block = -(-draws // blocks)
    cell, none = c("block") * shards + c("shard"), F.lit(None)
    left = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        cell.cast("int").alias("cell"), "seq", "name", "at", "k", "marks", none.cast("int").alias("draw"), none.cast("int").alias("side"),
        none.cast("array<int>").alias("clusters"), none.cast("array<int>").alias("times"))
    right = _draws(base, draws, seed).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("block", F.floor(c("draw") / block)).select(
        cell.cast("int").alias("cell"), F.lit(-1).alias("seq"), none.cast("string").alias("name"), *[none.cast("binary").alias(x) for x in ("at", "k", "marks")],
        "draw", "side", "clusters", "times")
    summed = (left.unionByName(right).repartitionById(blocks * shards, c("cell")).sortWithinPartitions("cell", "seq")
              .mapInArrow(_rank_sums(n, draws, block, shards), "name string, shard int, draw int, won double, pos double, neg double, no_pos double, no_neg double"))
    earlier = Window.partitionBy("name", "draw").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (summed.withColumn("won", c("won") + c("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
             .groupBy(c("name").alias(key), "draw").agg(F.sum("won").alias("won"), F.sum(c("pos") + c("no_pos")).alias("pos"), F.sum(c("neg") + c("no_neg")).alias("neg")))
    value = F.when((c("pos") > 0) & (c("neg") > 0), c("won") / (c("pos") * c("neg")))
    bounds = drawn.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("p")) \
        .select(key, F.coalesce(F.get("p", F.lit(0)), F.lit(0.0)).alias("lower"), F.coalesce(F.get("p", F.lit(1)), F.lit(1.0)).alias("upper"))   # a number a draw
    few = F.lit(n < 2)
    return auc(scores, [key]).join(bounds, key).select(key, "auc", F.when(few, 0.0).otherwise(c("lower")).alias("lower"),
                                                       F.when(few, 1.0).otherwise(c("upper")).alias("upper"))


# ----------------------------------------------------------- tolerances, weights
def tolerances(true: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """10th percentile of groove similarity, 90th of sub and brightness deltas (true pairs)."""
    keys = keys or []
    entries = [F.struct(F.lit(f).alias("factor"), c(f).alias("value")) for f in ("groove_sim", "sub_delta", "brightness_delta")]
    rows = true.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
    q = ordered.quantiles(rows, [*keys, "factor"], "value", {"p10": 0.10, "p90": 0.90})
    return q.groupBy(*keys).agg(F.max(F.when(c("factor") == "groove_sim", c("p10"))).alias("groove_sim_min"),
                                F.max(F.when(c("factor") == "sub_delta", c("p90"))).alias("sub_delta_max"),
                                F.max(F.when(c("factor") == "brightness_delta", c("p90"))).alias("brightness_delta_max"))


def learn_weights(found: DataFrame, total: float = MAX_BUDGET) -> DataFrame:
    """Share of a fixed budget by AUC above 0.5; equal shares if none is."""
    everything = Window.partitionBy(F.lit(1))   # one row per factor
    excess = F.greatest(F.lit(0.0), c("auc") - 0.5)
    rows = found.withColumn("excess", excess)
    whole = F.sum("excess").over(everything)
    return rows.withColumn("weight", F.when(whole > 0, c("excess") / whole * total).otherwise(
        F.lit(total) / F.count("*").over(everything))).drop("excess")


def learn_weights_bounded(found: DataFrame, most: float = MAX_BUDGET) -> DataFrame:
    """Share of a budget that grows with the best lower bound; a bound at 0.5 earns nothing."""
    everything = Window.partitionBy(F.lit(1))   # one row per factor
    rows = found.withColumn("raw", F.greatest(F.lit(0.0), c("lower") - 0.5) * 2.0)
    whole, best = F.sum("raw").over(everything), F.max("raw").over(everything)
    return rows.withColumn("weight", F.when(whole > 0, F.least(F.lit(1.0), best) * most * c("raw") / whole).otherwise(0.0)) \
        .drop("raw")


def factor_scales(deltas: DataFrame) -> DataFrame:
    """Largest value of every factor: one row."""
    return deltas.agg(*[F.coalesce(F.nullif(F.max(F.abs(c(f))), F.lit(0.0)), F.lit(1.0)).alias(f"scale_{f}") for f in DIRECTIONS])


def combined_score(deltas: DataFrame, weights: dict[str, float], scales: DataFrame) -> DataFrame:
    """Weighted score of a pair; distances are turned so that higher is better."""
    used = {f: w for f, w in weights.items() if w > 0}
    rows = deltas.withColumn("scales", scales.select(F.struct("*")).scalar())
    total = F.lit(0.0)
    for f, w in used.items():
        share = F.least(F.lit(1.0), F.abs(c(f)) / c(f"scales.scale_{f}"))
        total = total + (share if DIRECTIONS[f] else 1.0 - share) * w
    return rows.withColumn("score", total / sum(used.values()) if used else F.lit(0.0)) \
        .drop("scales")


def holdout_passed(scored: DataFrame, minimum: float = HOLDOUT_MIN_AUC) -> DataFrame:
    """AUC of the combined score on a held-out mix and whether it is good enough."""
    return auc(scored, [], "score").select(
        "auc", (c("auc") >= minimum).alias("passed"))


def _report(deltas: DataFrame, draws: int, seed: int) -> DataFrame:
    rows = long_deltas(deltas)
    bounded = learn_weights_bounded(auc_interval(rows, draws=draws, seed=seed))
    sizes = rows.groupBy("factor").agg(F.count_if("positive").alias("n_true"), F.count_if(~c("positive")).alias("n_random"))
    return bounded.join(sizes, "factor")


def mining_report(deltas: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Per factor: AUC, interval and learned weight, with the number of pairs."""
    return _report(lineage.stored(deltas), draws, seed)   # read by clusters, counts, ranks and sizes


# score weight -> the mined factors it sums (fixed values)
SCORE_WEIGHTS = {"groove_weight": ("groove_sim",), "bass_weight": ("sub_delta", "punch_delta"),
                 "timbre_weight": ("timbre_sim",), "mood_weight": ("brightness_delta",)}


def score_weights(report: DataFrame) -> DataFrame:
    """One row of pair-score weights from the weights of the mined factors."""
    total = {f: F.coalesce(F.sum(F.when(c("factor") == f, c("weight"))), F.lit(0.0)) for f in DIRECTIONS}
    return report.agg(*[sum((total[f] for f in rest), total[first]).alias(name) for name, (first, *rest) in SCORE_WEIGHTS.items()])


def genre_overrides(report: DataFrame, genres: list[str]) -> DataFrame:
    """The mined weights as an override per genre for ``resolve_weights``."""
    return score_weights(report).select(F.explode(F.array(*[F.lit(g) for g in genres])).alias("genre"), "*")


def mining_summary(deltas: DataFrame, genre: str, holdout_mix: int, draws: int = 2000, seed: int = 42) -> DataFrame:
    """One row of a genre: pairs, score weights, tolerances, and the AUC of a mix that was not learned from.

    The five factor weights learned from the other mixes are read back to score the
    held-out mix; nothing else reaches the driver.
    """
    deltas = lineage.stored(deltas)   # read by the report, the scales, the test and the tolerances
    learned = deltas.where(c("mix_id") != holdout_mix)
    report = lineage.stored(_report(learned, draws, seed))
    weights = {r["factor"]: r["weight"] for r in report.select("factor", "weight").collect()}
    tested = deltas.where(c("mix_id") == holdout_mix)
    passed = holdout_passed(combined_score(tested, weights, factor_scales(learned)))
    sizes = report.agg(F.max("n_true").alias("n_true"), F.max("n_random").alias("n_random"))
    row = F.struct(F.lit(genre).alias("genre"))
    parts = [sizes, score_weights(report), tolerances(learned.where("positive")), passed.select(c("auc").alias("holdout_auc"), c("passed").alias("holdout"))]
    return deltas.sparkSession.range(1).select(row.alias("g"), *[p.select(F.struct("*")).scalar().alias(f"p{i}") for i, p in enumerate(parts)]) \
        .select("g.*", *[f"p{i}.*" for i in range(len(parts))])
