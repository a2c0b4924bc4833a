"""K-means of its own for every group, all groups in the same jobs (M3, M5, M7 per upload batch).

Rows are first counted per (group, distinct vector); everything below works on these
weighted vectors. A group of up to ``WHOLE`` of them (an upload batch) is shuffled once, to
one array, and numpy takes the steps of all its models (``fit_whole``). A larger group is
split over tasks: there a model is a row (group, start, k and its centres), and a step of
Lloyd's iteration joins vectors and models on the group and sums per cluster. So neither
the number of groups nor the size of one is bounded by a task, and both ways follow the
same rules:

* Starts. Rows lie on a ring by one hash of their key; start ``s`` takes the vector of
  the first row after the point s / 32, then again and again the vector farthest from
  those taken. The first k of them begin the model of k, so all k share one chain.
* Ties. Distances and centres are rounded to nine decimals, ties go to the lowest
  centre: the result depends on nothing but the rows, in any engine.
* k by the silhouette over all rows (squared distances from cluster sums, see
  ``clustering.silhouette``), the start of lowest cost for each k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialize

RING = 1 << 60
POINTS = 32  # of the ring
SEARCH_STARTS = (0, 1, 2)
STABILITY_K, STABILITY_PAIRS = 3, ((0, 1), (10, 11), (20, 21))
STEPS, STEPS_A_JOB = 20, 4
DIGITS = 9
#: Distinct vectors of a group up to which one task fits its models; larger groups are split over tasks.
WHOLE = 20_000


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _closest(dims: int, centres: str = "centres", x: str = "x") -> Column:
    """Squared distance ``d`` of a vector to the centre nearest to it, and that centre's number ``c``."""
    v = F.col(x)
    return F.array_min(F.transform(centres, lambda m, i: F.struct(
        F.round(_sum([(v[j] - m[j]) * (v[j] - m[j]) for j in range(dims)]), DIGITS).alias("d"), i.alias("c"))))


def _nearest(dims: int, centres: str = "centres") -> Column:
    return _closest(dims, centres)["c"]


def _ring_place(key_cols) -> Column:
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def weighted_vectors(df: DataFrame, group_cols, cols, score: str, key_cols, starts) -> DataFrame:
    """One row per group and distinct vector ``x``: rows ``w``, their ``score`` summed, and per
    start the place of the first of them after the start's point."""
    place = _ring_place(key_cols)
    x = F.array(*[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), DIGITS) for c in cols])
    rows = df.select(*group_cols, x.alias("x"), F.col(score).cast("double").alias("_s"), place.alias("_p"))
    after = [F.min(F.pmod(F.col("_p") - F.lit(s * (RING // POINTS)), F.lit(RING))).alias(f"after{s}") for s in starts]
    return rows.groupBy(*group_cols, "x").agg(F.count(F.lit(1)).alias("w"), F.sum("_s").alias("score"), *after)


def _first_centres(vectors: DataFrame, group_cols, starts, most: int, dims: int) -> DataFrame:
    """Up to ``most`` centres per group and start, each a vector farthest from those before."""
    firsts = vectors.groupBy(*group_cols).agg(*[F.min_by("x", F.struct(f"after{s}", "x")).alias(f"x{s}") for s in starts])
    state = firsts.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(s).alias("start"), F.array(f"x{s}").alias("centres")) for s in starts])))
    points = vectors.select(*group_cols, "x")
    for _ in range(most - 1):
        pairs = points.join(state, group_cols).withColumn("far", F.struct(_closest(dims)["d"].alias("d"), "x"))
        state = pairs.groupBy(*group_cols, "start").agg(F.first("centres").alias("centres"), F.max("far").alias("far")).select(
            *group_cols, "start", F.when(F.col("far.d") > 0, F.concat("centres", F.array("far.x"))).otherwise(F.col("centres")).alias("centres"))
    return state


def _stepper(vectors: DataFrame, group_cols, dims: int) -> Callable[[DataFrame], DataFrame]:
    """One step of Lloyd's iteration as a function of the models; a centre without rows stays
    where it is. The columns are built once, as building them takes longer than a small step."""
    name = [*group_cols, "start", "k"]
    nearest = _nearest(dims)
    mean = F.array(*[F.round(F.sum(F.col("x")[i] * F.col("w")) / F.sum("w"), DIGITS) for i in range(dims)]).alias("mean")
    kept, old = F.first("centres").alias("centres"), F.first("centres").alias("old")
    at = F.map_from_entries(F.collect_list(F.struct("c", "mean"))).alias("at")  # k entries
    centres = F.transform("old", lambda c, i: F.coalesce(F.try_element_at("at", i), c)).alias("centres")
    moved = (F.col("centres") != F.col("old")).alias("moved")
    row = [F.col(c) for c in vectors.columns if c in (*group_cols, "x", "w")] + [F.col(c) for c in ("start", "k", "centres")] + [nearest.alias("c")]

    def step(models: DataFrame) -> DataFrame:
        means = vectors.join(models, group_cols).select(*row).groupBy(*name, "c").agg(kept, mean)
        new = means.groupBy(*name).agg(old, at).select(*name, "old", centres)
        return new.select(*name, "centres", moved)

    return step


def fit_by_group(vectors: DataFrame, group_cols, ks, dims: int, starts=SEARCH_STARTS, extra_starts=(), extra_k: int = STABILITY_K) -> DataFrame:
    """The models of every group: group, start, k, centres. ``starts`` get every k of ``ks`` that
    the group has distinct vectors for, ``extra_starts`` only ``extra_k``."""
    both, most = sorted({*starts, *extra_starts}), max(*ks, extra_k)
    first = _first_centres(vectors, group_cols, both, most, dims)
    asked = [F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s in both
             for k in sorted({*(ks if s in starts else ()), *((extra_k,) if s in extra_starts else ())})]
    models = first.withColumn("a", F.explode(F.array(*asked))).where((F.col("a.s") == F.col("start")) & (F.size("centres") >= F.col("a.k")))
    models = models.select(*group_cols, "start", F.col("a.k").alias("k"), F.slice("centres", 1, F.col("a.k")).alias("centres"), F.lit(True).alias("moved"))
    models = materialize(models, "group-centres")
    step = _stepper(vectors, group_cols, dims)
    for _ in range(STEPS // STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            models = step(models)
        models = materialize(models, "group-centres")
        if models.where("moved").isEmpty():
            break
    return models.drop("moved")


def lowest_cost(vectors: DataFrame, models: DataFrame, group_cols, dims: int) -> DataFrame:
    """Per group and k the model of lowest cost (ties: lowest start): k, centres, cost."""
    near = vectors.join(models, group_cols).withColumn("d", _closest(dims)["d"] * F.col("w"))
    cost = near.groupBy(*group_cols, "k", "start").agg(F.first("centres").alias("centres"), F.round(F.sum("d"), 6).alias("cost"))
    best = cost.groupBy(*group_cols, "k").agg(F.min(F.struct("cost", "start", "centres")).alias("b"))
    return best.select(*group_cols, "k", "b.centres", "b.cost")


def silhouette_by_group(vectors: DataFrame, models: DataFrame, group_cols, dims: int) -> DataFrame:
    """Per group and k the mean silhouette over all rows, four decimals; none with fewer than
    two clusters that hold rows."""
    x = [F.col("x")[i] for i in range(dims)]
    own = vectors.join(models.select(*group_cols, "k", "centres"), group_cols).withColumn("c", _nearest(dims)).withColumn("sq", _sum([v * v for v in x]))
    sums = own.groupBy(*group_cols, "k", "c").agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("sq") * F.col("w")).alias("q"),
                                                  F.array(*[F.sum(v * F.col("w")) for v in x]).alias("s"))
    packed = sums.groupBy(*group_cols, "k").agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("all")).where(F.size("all") > 1)  # k entries
    rows = own.join(packed, [*group_cols, "k"])

    def far(o: Column) -> Column:
        return (o["n"] * F.col("sq") - 2 * _sum([x[i] * o["s"][i] for i in range(dims)]) + o["q"]) / o["n"]

    rows = rows.withColumn("own", F.filter("all", lambda o: o["c"] == F.col("c"))[0])
    n = F.col("own.n")
    a = F.when(n > 1, far(F.col("own")) * n / (n - 1)).otherwise(0.0)
    b = F.array_min(F.transform(F.filter("all", lambda o: o["c"] != F.col("c")), far))
    s = F.when(n > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    return rows.groupBy(*group_cols, "k").agg(F.round(F.sum(s * F.col("w")) / F.sum("w"), 4).alias("silhouette"))


def stability_by_group(vectors: DataFrame, models: DataFrame, group_cols, dims: int, k: int = STABILITY_K, pairs=STABILITY_PAIRS) -> DataFrame:
    """M7 + M8 per group: mean adjusted Rand index between the models of each pair of starts."""
    some = models.where(F.col("k") == k)
    one = some.select(*group_cols, "start", F.col("centres").alias("one"))
    two = some.select(*group_cols, F.col("start").alias("next"), F.col("centres").alias("two"))
    wanted = reduce(lambda p, q: p | q, [(F.col("start") == a) & (F.col("next") == b) for a, b in pairs])
    both = one.join(two, group_cols).where(wanted)
    cells = vectors.join(both, group_cols).groupBy(*group_cols, "start", _nearest(dims, "one").alias("a"), _nearest(dims, "two").alias("b")).agg(
        F.sum("w").cast("double").alias("n"))
    tables = cells.groupBy(*group_cols, "start").agg(F.collect_list(F.struct("a", "b", "n")).alias("t"), F.sum("n").alias("all"))  # k x k cells
    total = lambda cond: F.aggregate(F.filter("t", cond), F.lit(0.0), lambda t, v: t + v["n"])
    c2 = lambda n: n * (n - 1) / 2.0
    pairs_in = lambda side: F.aggregate(F.transform(F.array_distinct(F.transform("t", lambda e: e[side])), lambda v: c2(
        total(lambda e: e[side] == v))), F.lit(0.0), lambda t, v: t + v)
    same = F.aggregate("t", F.lit(0.0), lambda t, e: t + c2(e["n"]))
    expected = F.coalesce(F.try_divide(pairs_in("a") * pairs_in("b"), c2(F.col("all"))), F.lit(0.0))
    top = (pairs_in("a") + pairs_in("b")) / 2.0
    ari = F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((same - expected) / (top - expected))
    return tables.select(*group_cols, ari.alias("ari")).groupBy(*group_cols).agg(F.round(F.avg("ari"), 4).alias("cluster_stability"))


def models_by_group(vectors: DataFrame, group_cols, dims: int, ks, most: int) -> DataFrame:
    """M3 + M5 + M7: one row per group that has two distinct vectors or more: the chosen ``k``
    (at most ``most``), ``silhouette`` of the k found best, ``centres``, the ids of the
    centres by ascending mean score (then place), and ``cluster_stability``."""
    extra = tuple(s for pair in STABILITY_PAIRS for s in pair)
    models = fit_by_group(vectors, group_cols, ks, dims, SEARCH_STARTS, extra)
    best = materialize(lowest_cost(vectors, models.where(F.col("start").isin(*SEARCH_STARTS)), group_cols, dims), "group-best")
    found = silhouette_by_group(vectors, best, group_cols, dims)
    chosen = found.groupBy(*group_cols).agg(F.max(F.struct("silhouette", (-F.col("k")).alias("k"))).alias("m")).select(
        *group_cols, F.least(-F.col("m.k"), F.lit(most)).alias("k"), "m.silhouette")
    final = best.join(chosen, [*group_cols, "k"])
    profile = vectors.join(final, group_cols).withColumn("c", _nearest(dims)).groupBy(*group_cols, "k", "silhouette", "c").agg(
        F.first("centres").alias("centres"), F.round(F.sum("score") / F.sum("w"), DIGITS).alias("risk"))
    ranked = profile.groupBy(*group_cols, "k", "silhouette").agg(F.first("centres").alias("centres"), F.sort_array(F.collect_list(
        F.struct("risk", F.get("centres", F.col("c")).alias("at"), "c"))).alias("order"))  # k entries
    ids = F.transform("centres", lambda x, i: (F.array_position(F.transform("order", lambda o: o["c"]), i) - 1).cast("int"))
    stable = stability_by_group(vectors, models, group_cols, dims)
    return materialize(ranked.select(*group_cols, "k", "silhouette", "centres", ids.alias("ids")).join(stable, group_cols, "left"), "group-models")


def _rounded(v: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """``v`` to so many decimals, halves away from zero."""
    scaled = np.asarray(v) * 10.0 ** digits
    out = np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0 ** digits
    return np.where(np.isfinite(out), out, v)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(model, vector, centre): squared distances; a model's centres may end in NaN, which is far from all."""
    parts = [x[None, :, None, j] - centres[:, None, :, j] for j in range(x.shape[1])]
    d = _rounded(reduce(lambda a, b: a + b, [v * v for v in parts]))
    return np.where(np.isnan(d), np.inf, d)


def _whole_firsts(x: np.ndarray, after: np.ndarray, most: int) -> list[np.ndarray]:
    """``_first_centres`` of a group: per start the places in ``x`` (ascending) of up to ``most`` vectors."""
    m = len(x)
    taken = [[int(i)] for i in after.argmin(axis=0)]
    near = np.full((len(taken), m), np.inf)
    for _ in range(most - 1):
        near = np.minimum(near, _gaps(x, x[[t[-1] for t in taken]][:, None])[:, :, 0])
        for t, d, i in zip(taken, near, m - 1 - near[:, ::-1].argmax(axis=1)):
            if d[i] > 0:
                t.append(int(i))
    return [np.array(t) for t in taken]


def _whole_steps(x: np.ndarray, w: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lloyd's steps of all models of a group at once; models that have settled are left out."""
    moving, most = np.arange(len(centres)), centres.shape[1]
    for _ in range(STEPS):
        old = centres[moving]
        at = (_gaps(x, old).argmin(axis=2) + most * np.arange(len(moving))[:, None]).ravel()
        size = len(moving) * most
        rows = np.bincount(at, np.tile(w, len(moving)), size)
        sums = np.stack([np.bincount(at, np.tile(x[:, j] * w, len(moving)), size) for j in range(x.shape[1])], axis=1)
        means = _rounded(sums / rows[:, None]).reshape(old.shape)
        new = np.where(rows.reshape(old.shape[:2])[:, :, None] > 0, means, old)
        centres[moving] = new
        moving = moving[((new != old) & ~(np.isnan(new) & np.isnan(old))).any(axis=(1, 2))]
        if not len(moving):
            break
    return centres


def _whole_silhouette(x: np.ndarray, w: np.ndarray, label: np.ndarray, k: int) -> float | None:
    """``silhouette_by_group`` of one k of a group."""
    n = np.bincount(label, w, k)
    held = np.flatnonzero(n > 0)
    if len(held) < 2:
        return None
    sq = reduce(lambda a, b: a + b, [v * v for v in x.T])
    q = np.bincount(label, sq * w, k)
    sums = [np.bincount(label, v * w, k) for v in x.T]
    dot = reduce(lambda a, b: a + b, [v[:, None] * s[None, held] for v, s in zip(x.T, sums)])
    far = (n[held] * sq[:, None] - 2 * dot + q[held]) / n[held]
    own = held[None, :] == label[:, None]
    rows = n[label]
    a = np.where(own, far, 0.0).sum(axis=1) * rows / (rows - 1)
    b = np.where(own, np.inf, far).min(axis=1)
    top = np.maximum(a, b)
    s = np.where((rows > 1) & (top != 0), (b - a) / top, 0.0)
    return float(_rounded((s * w).sum() / w.sum(), 4))


def _whole_ari(w: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Adjusted Rand index of two labels of a group's vectors."""
    table = np.bincount(a * k + b, w, k * k).reshape(k, k)
    c2 = lambda n: float((n * (n - 1) / 2.0).sum())
    one, two, everything = c2(table.sum(axis=1)), c2(table.sum(axis=0)), c2(table.sum())
    expected = one * two / everything if everything else 0.0
    top = (one + two) / 2.0
    return 1.0 if abs(top - expected) < 1e-12 else (c2(table) - expected) / (top - expected)


def fit_whole(x: np.ndarray, w: np.ndarray, score: np.ndarray, after: np.ndarray, starts, ks, most: int) -> dict | None:
    """``models_by_group`` of one group of weighted vectors, in ascending order; ``after`` has a
    column a start, a missing score is NaN. None if there are no two clusters."""
    pairs = [p for pair in STABILITY_PAIRS for p in pair]
    models = [(s, k, first) for s, first in zip(starts, _whole_firsts(x, after, max(*ks, STABILITY_K)))
              for k in sorted({*(ks if s in SEARCH_STARTS else ()), *((STABILITY_K,) if s in pairs else ())}) if len(first) >= k]
    if not models:
        return None
    centres = np.full((len(models), max(k for _, k, _ in models), x.shape[1]), np.nan)
    for at, (_, k, first) in enumerate(models):
        centres[at, :k] = x[first[:k]]
    centres = _whole_steps(x, w, centres)
    d = _gaps(x, centres)
    label = d.argmin(axis=2)
    cost = _rounded((d.min(axis=2) * w).sum(axis=1), 6)
    place = {(s, k): at for at, (s, k, _) in enumerate(models)}
    best = {k: min((cost[place[s, k]], s, place[s, k]) for s in SEARCH_STARTS if (s, k) in place)[2] for k in ks if any((s, k) in place for s in SEARCH_STARTS)}
    found = [(v, -k) for k, at in best.items() if (v := _whole_silhouette(x, w, label[at], k)) is not None]
    if not found:
        return None
    silhouette, k = max(found)
    k = min(-k, most)
    if k not in best:
        return None
    own, at = label[best[k]], centres[best[k], :k]
    held, known = np.bincount(own, w, k), np.bincount(own, ~np.isnan(score), k)
    with np.errstate(all="ignore"):
        risk = _rounded(np.bincount(own, np.nan_to_num(score), k) / held)
    order = sorted(np.flatnonzero(held > 0).tolist(), key=lambda c: (bool(known[c]), risk[c] if known[c] else 0.0, at[c].tolist(), c))
    aris = [_whole_ari(w, label[place[a, STABILITY_K]], label[place[b, STABILITY_K]], STABILITY_K)
            for a, b in STABILITY_PAIRS if (a, STABILITY_K) in place and (b, STABILITY_K) in place]
    return {"k": k, "silhouette": silhouette, "centres": at.tolist(), "ids": [order.index(c) if c in order else -1 for c in range(k)],
            "cluster_stability": float(_rounded(sum(aris) / len(aris), 4)) if aris else None}


def models_of_whole_groups(vectors: DataFrame, group_cols, dims: int, starts, ks, most: int) -> DataFrame:
    """``models_by_group`` of groups that fit a task each: a group is shuffled once, to arrays."""
    spark, ks = vectors.sparkSession, list(ks)
    # a number of partitions of its own: few bytes of much work are not to be put together by size
    rows = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group_cols)
    after = F.array(*[f"after{s}" for s in starts])
    packed = rows.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct("x", "w", "score", after.alias("after")))).alias("v"))
    part = lambda c: F.transform("v", lambda v: v[c])
    packed = packed.select(F.struct(*group_cols).alias("g"), F.flatten(part("x")).alias("x"), part("w").alias("w"), part("score").alias("score"),
                           F.flatten(part("after")).alias("after"))
    model = T._parse_datatype_string("struct<k:int,silhouette:double,centres:array<array<double>>,ids:array<int>,cluster_stability:double>")
    arrow = pa.struct([("k", pa.int32()), ("silhouette", pa.float64()), ("centres", pa.list_(pa.list_(pa.float64()))), ("ids", pa.list_(pa.int32())),
                       ("cluster_stability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                fits = []
                for x, w, score, after in zip(*b.columns[1:]):
                    x, w, score, after = (v.values.to_numpy(zero_copy_only=False) for v in (x, w, score, after))
                    fits.append(fit_whole(x.reshape(-1, dims), w, score.astype(float), after.reshape(-1, len(starts)), starts, ks, most))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fits, arrow)], names=["g", "m"])

    schema = T.StructType([packed.schema["g"], T.StructField("m", model)])
    return materialize(packed.mapInArrow(run, schema).where("m IS NOT NULL").select("g.*", "m.*"), "group-models")


def cluster_by_group(df: DataFrame, group_cols, cols, score: str = "behavioral_risk_score", key_cols=("session", "seg"),
                     ks=range(2, 6), most: int = 4) -> DataFrame:
    """``df`` with ``behavior_cluster`` and ``cluster_stability``, a k-means per group over ``cols``
    (standardised within the group; null counts 0). Rows of a group of fewer than two
    distinct vectors, or without a group, are cluster 0 of stability 0."""
    group_cols, cols = list(group_cols), list(cols)
    starts = sorted({*SEARCH_STARTS, *(s for pair in STABILITY_PAIRS for s in pair)})
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group_cols])
    vectors = materialize(weighted_vectors(df.where(named), group_cols, cols, score, key_cols, starts), "group-vectors")
    large = vectors.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).drop("n")
    if large.isEmpty():
        models = models_of_whole_groups(vectors, group_cols, len(cols), starts, ks, most)
    else:
        large = materialize(large, "large-groups")
        split = materialize(vectors.join(large, group_cols, "left_semi"), "group-vectors")
        models = models_of_whole_groups(vectors.join(large, group_cols, "left_anti"), group_cols, len(cols), starts, ks, most).unionByName(
            models_by_group(split, group_cols, len(cols), list(ks), most))
    models = models.select(
        *group_cols, F.struct("centres", "ids", "cluster_stability").alias("_model"))
    x = F.array(*[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), DIGITS) for c in cols])
    rows = df.withColumn("_x", x).join(models, group_cols, "left").withColumn("_c", _closest(len(cols), "_model.centres", "_x")["c"])
    return rows.withColumns({"behavior_cluster": F.coalesce(F.get("_model.ids", F.col("_c")), F.lit(0)),
                             "cluster_stability": F.coalesce("_model.cluster_stability", F.lit(0.0))}).drop("_x", "_model", "_c")
