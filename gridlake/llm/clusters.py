"""Hierarchical density clustering of daily curves by shape.

Mutual-reachability neighbour graph -> distributed Boruvka minimum spanning tree -> condensed
hierarchy -> clusters by stability, with the most persistent members as exemplars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.runtime import cut, discard, require

HOURS = 24
BLOCK = 512  # rows compared at once
REACH = 4096  # rows before and after a block that it is compared with
FLOOR = 1e-4  # distances below count as this


def shapes(curves: list[list | None]) -> np.ndarray:
    """Rows of 24 hours relative to their mean; NaN rows where there is no shape.

    Days of 23 or 25 hours are brought to 24 at the hour of the clock change; NULL hours are
    interpolated around the clock. A curve without values or with a mean of zero has no shape.
    """
    out = np.full((len(curves), HOURS), np.nan)
    for r, c in enumerate(curves):
        v = np.array([np.nan if x is None else x for x in c or []], float)
        if len(v) == 23:
            v = np.insert(v, 2, np.nan)
        elif len(v) == 25:
            v = np.concatenate([v[:2], [np.nanmean(v[2:4]) if np.isfinite(v[2:4]).any() else np.nan], v[4:]])
        elif len(v) != HOURS and len(v):
            v = np.interp((np.arange(HOURS) + 0.5) / HOURS, (np.arange(len(v)) + 0.5) / len(v), v)
        good = np.isfinite(v)
        if len(v) != HOURS or not good.any():
            continue
        if not good.all():
            at = np.flatnonzero(good)
            v = np.interp(np.arange(HOURS), np.concatenate([at - HOURS, at, at + HOURS]), np.tile(v[at], 3))
        mean = v.mean()
        if abs(mean) > 1e-12:
            out[r] = v / mean
    return out


def shape_table(df: DataFrame, id_column: str, curve: str) -> DataFrame:
    """(id, node, shape): node numbers the shape to four decimals, so exact copies share one; NULL without a shape."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.round(shapes(b.column("curve").to_pylist()), 4) + 0.0
            ok = np.isfinite(x[:, 0]) if len(x) else np.zeros(0, bool)
            rows = pa.array([v if k else None for v, k in zip(x.astype(np.float32).tolist(), ok, strict=True)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), rows], ["id", "shape"])

    got = df.select(F.col(id_column).alias("id"), F.col(curve).alias("curve")).mapInArrow(run, f"id {kind}, shape array<float>")
    return got.select("id", F.when(F.col("shape").isNotNull(), F.xxhash64("shape")).alias("node"), "shape")


def neighbours(nodes: DataFrame, k: int, rounds: int, cell: float, seed: int) -> DataFrame:
    """(node, near, chain): per round the k nearest rows among some thousands in the same region, and the row before.

    A round sorts the nodes by the cell of a random grid they fall in and, within a cell, along a
    random direction; every block of the order is compared with itself and the REACH rows before
    and after it. A cell of any size is so many blocks; the rounds' grids and orders differ, which
    links them and finds neighbours across the edges of tasks.
    """
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(rounds, 4, HOURS))
    axes /= np.linalg.norm(axes, axis=2, keepdims=True)
    offset = rng.uniform(0, cell, size=(rounds, 3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("shape").flatten().to_numpy().reshape(-1, HOURS)
            for r in range(rounds):
                p = x @ axes[r].T.astype(np.float32)
                c = np.floor((p[:, :3] + offset[r]) / cell).astype(np.int64) + 4096
                key = (np.clip(c[:, 0], 0, 8191) << 26) + (np.clip(c[:, 1], 0, 8191) << 13) + np.clip(c[:, 2], 0, 8191)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r, np.int32)), pa.array(key), pa.array(p[:, 3].astype(np.float64)), b.column("node"), b.column("shape")], ["round", "cell", "along", "node", "shape"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, x, lap = np.zeros(0, np.int64), np.zeros((0, HOURS), np.float32), np.zeros(0, np.int32)
        begin = 0  # the first row without result; rows before it are context
        for b in _chained(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                node = np.concatenate([node, b.column("node").to_numpy()])
                x = np.concatenate([x, b.column("shape").flatten().to_numpy().reshape(-1, HOURS)])
                lap = np.concatenate([lap, b.column("round").to_numpy()])
            stop = len(node) if b is None else max(begin, len(node) - REACH)
            while begin < stop and (b is None or begin + BLOCK <= stop):
                end = min(begin + BLOCK, stop)
                yield _near(node, x, lap, begin, end, k)
                begin = end
            drop = max(0, begin - REACH)
            node, x, lap, begin = node[drop:], x[drop:], lap[drop:], begin - drop

    placed = nodes.select("node", "shape").mapInArrow(place, "round int, cell bigint, along double, node bigint, shape array<float>")
    edge = "array<struct<d: float, to: bigint>>"
    return placed.repartitionByRange("round", "cell", "along").sortWithinPartitions("round", "cell", "along", "node").mapInArrow(compare, f"node bigint, near {edge}, chain {edge}")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near(node: np.ndarray, x: np.ndarray, lap: np.ndarray, begin: int, end: int, k: int) -> pa.RecordBatch:
    lo, hi = max(0, begin - REACH), min(len(node), end + REACH)
    a, c = x[begin:end], x[lo:hi]
    i = np.arange(end - begin)[:, None]
    # Squared distance but for what a row has in common; one product gives it. Padded to whole groups.
    groups = -(-(hi - lo) // 16)
    d = np.full((end - begin, 16 * groups), np.inf, np.float32)
    mean = a.mean(0)
    d[:, : hi - lo] = np.column_stack([-2 * (a - mean), np.ones(len(a), np.float32)]) @ np.column_stack([c - mean, ((c - mean) ** 2).sum(1)]).T
    d[i[:, 0], np.arange(begin - lo, end - lo)] = np.inf
    if lap[lo] != lap[hi - 1]:
        d[:, : hi - lo][lap[begin:end, None] != lap[None, lo:hi]] = np.inf
    few = min(k, hi - lo - 1)
    if few > 0:
        # The k smallest lie in the k groups with the smallest minima.
        least = d.reshape(len(a), 16, groups).min(axis=1)
        top = np.argpartition(least, min(few, groups) - 1, axis=1)[:, : min(few, groups)]
        among = (top[:, :, None] + groups * np.arange(16)).reshape(len(a), -1)
        few = min(few, among.shape[1])
        pick = among[i, np.argpartition(d[i, among], few - 1, axis=1)[:, :few]]
    else:
        pick = np.zeros((end - begin, 0), np.int64)
    ok = np.isfinite(d[i, pick])
    pick = np.minimum(pick, hi - lo - 1)
    true = np.round(np.sqrt(((a[:, None] - c[pick]) ** 2).mean(2)), 5)
    near = _edges(true, node[lo:hi][pick], ok)
    before = np.arange(begin, end) - 1
    prev = np.maximum(before, 0)
    gap = np.round(np.sqrt(((a - x[prev]) ** 2).mean(1)), 5)
    chain = _edges(gap[:, None], node[prev][:, None], ((before >= 0) & (lap[prev] == lap[begin:end]))[:, None])
    return pa.RecordBatch.from_arrays([pa.array(node[begin:end]), near, chain], ["node", "near", "chain"])


def _edges(d: np.ndarray, to: np.ndarray, ok: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(d[ok].astype(np.float32)), pa.array(to[ok])], ["d", "to"])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def reachability_graph(near: DataFrame, k: int, samples: int) -> DataFrame:
    """(a, b, w), a < b: mutual reachability over the k nearest neighbours of all rounds and the rounds' chains."""
    lists = near.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.array_distinct(F.flatten(F.collect_list("chain"))).alias("chain"))
    lists = lists.withColumn("core", F.when(F.size("near") > 0, F.element_at("near", F.least(F.lit(samples), F.size("near")))["d"]))
    lists = cut(lists.select("node", "core", F.array_union(F.slice("near", 1, k), "chain").alias("edges")))
    cores = lists.select(F.col("node").alias("to"), F.col("core").alias("core_to"))
    out = lists.select("node", "core", F.inline("edges").alias("d", "to")).where("node <> to").join(cores, "to")
    w = F.greatest("core", "core_to", "d").cast("double")
    return out.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def contract(edges: DataFrame, limit: int, labels: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Boruvka rounds until at most ``limit`` edges are left: (tree edges found, edges left, labels).

    A round lets every component choose its lightest edge (ties by the end nodes' numbers), follows
    the choices to one root each by pointer jumping, and keeps the lightest edge between any two
    roots. ``edges``: (a, b, w). Edges left: (a, b, w, oa, ob), between components a and b, of
    nodes oa and ob. ``labels``: (node, root), brought up to date if given.
    """
    cur = cut(edges.select("a", "b", "w", F.col("a").alias("oa"), F.col("b").alias("ob")))
    tree: list[DataFrame] = []
    while cur.count() > limit:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "oa", "ob"))
        best = cut(both.groupBy("a").agg(F.min(F.struct("w", F.least("oa", "ob").alias("lo"), F.greatest("oa", "ob").alias("hi"), "b")).alias("e")).select("a", "e.*"))
        tree.append(best.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct())
        back = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        up = cut(best.join(back, "b", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up")))
        while True:
            above = up.select(F.col("a").alias("up"), F.col("up").alias("higher"))
            nxt = cut(up.join(above, "up").select("a", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")))
            discard(up)
            up = nxt
            if nxt.where("moved").isEmpty():
                break
        ra, rb = up.select("a", F.col("up").alias("ra")), up.select(F.col("a").alias("b"), F.col("up").alias("rb"))
        moved = cur.join(ra, "a").join(rb, "b").where("ra <> rb")
        left = cut(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("w", "oa", "ob")).alias("e")).select("a", "b", "e.*"))
        discard(cur)
        cur = left
        if labels is not None:
            labels = cut(labels.join(up.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return tree, cur, labels


def spanning_tree(edges: DataFrame, limit: int = 100_000) -> DataFrame:
    """(a, b, w) of the minimum spanning forest: distributed rounds, then one task for at most ``limit`` edges."""
    tree, rest, _ = contract(edges, limit)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            e = pd.concat(got, ignore_index=True)
            lo, hi = np.minimum(e.oa, e.ob), np.maximum(e.oa, e.ob)
            order = np.lexsort((hi, lo, e.w))
            names, ends = np.unique(np.concatenate([e.a, e.b]), return_inverse=True)
            keep = kruskal(len(names), ends[: len(e)][order], ends[len(e) :][order])
            at = order[keep]
            yield pd.DataFrame({"a": lo.to_numpy()[at], "b": hi.to_numpy()[at], "w": e.w.to_numpy()[at]})

    out = rest.repartition(1).mapInPandas(finish, "a bigint, b bigint, w double")
    for t in tree:
        out = out.unionByName(t)
    return out


def kruskal(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the forest's edges among edges sorted by weight."""
    up = list(range(n))
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def climb(parts: list[list], a: np.ndarray, b: np.ndarray, w: np.ndarray, least: float, merge_below: float, first: int) -> tuple[np.ndarray, list[tuple], list[tuple]]:
    """Condense single linkage from its leaves up along edges of ascending weight: (root of each part, left, closed).

    A part is [mass, area, run, below, late, members], and is changed to what it has grown to. One
    that weighs ``least`` is the inside of a cluster, its run: area is the sum of mass over the
    distance at which it left the run, below the stability of the clusters the run splits into
    (-inf: none), late whether it splits below ``merge_below``. Lighter ones hold their nodes.
    left: (node, run, distance); closed: (run, run it is split from, chosen). New runs are numbered
    from ``first``. The edges may come in any number of ascending calls; the results are the same.
    """
    up = list(range(len(parts)))
    left: list[tuple] = []
    closed: list[tuple] = []
    for x, y, d in zip(a.tolist(), b.tolist(), np.maximum(w, FLOOR).tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        p, q = parts[x], parts[y]
        if p[0] > q[0]:
            p, q = q, p
        mass, lam = p[0] + q[0], 1 / d
        if mass < least:
            grown = [mass, 0.0, -1, -np.inf, False, p[5] + q[5]]
        elif q[0] < least:
            left += ((s, first, d) for s in p[5] + q[5])
            grown = [mass, mass * lam, first, -np.inf, False, []]
            first += 1
        elif p[0] < least:
            left += ((s, q[2], d) for s in p[5])
            grown = [mass, q[1] + p[0] * lam, *q[2:]]
        else:
            below = close(p, lam, first, closed) + close(q, lam, first, closed)
            grown = [mass, mass * lam, first, below, lam > 1 / merge_below, []]
            first += 1
        up[x] = y
        parts[x], parts[y] = [], grown
    root = np.array(up, np.int64)
    while (root[root] != root).any():
        root = root[root]
    return root, left, closed


def close(part: list, lam: float, by: int, closed: list[tuple]) -> float:
    """End a part's run at its birth ``lam``, a split of the run ``by``: the larger of its stability and that of the clusters below."""
    mass, area, run, below, late, _ = part
    stability = area - mass * lam
    closed.append((run, by, bool(late or stability >= below)))
    return max(stability, below)


def condense(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, weight: np.ndarray, least: int, merge_below: float) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, fall) of n nodes from a spanning forest's edges: the cluster chosen or -1, and the distance at which a node leaves it.

    Single linkage of the forest is condensed: a split counts if both sides weigh ``least``,
    otherwise the lighter side's nodes fall out of the cluster. Of nested clusters the more stable
    are chosen (excess of mass), but none that was born below the distance ``merge_below``: its
    ancestor stands for it. Nodes that fall out at more than ``merge_below`` belong to none.
    """
    order = np.argsort(w, kind="stable")
    heavy = (weight >= least).tolist()
    parts = [[m, m / FLOOR, i, -np.inf, False, []] if h else [m, 0.0, -1, -np.inf, False, [i]] for i, (m, h) in enumerate(zip(weight.astype(float).tolist(), heavy, strict=True))]
    root, left, closed = climb(parts, a[order], b[order], w[order], least, merge_below, n)
    left += ((i, i, FLOOR) for i, h in enumerate(heavy) if h)
    for r in np.flatnonzero(root == np.arange(n)).tolist():
        if parts[r][0] >= least:
            close(parts[r], 0.0, -1, closed)
    stands: dict[int, int] = {-1: -1}
    for run, by, chosen in reversed(closed):  # clusters are closed after those they split into
        stands[run] = stands[by] if stands[by] >= 0 else run if chosen else -1
    cluster, fall = np.full(n, -1), np.full(n, np.inf)
    for s, run, d in left:
        # A node that falls out of a cluster's inside leaves the cluster itself at that distance.
        cluster[s], fall[s] = stands[run], d
    return np.where(fall <= merge_below, cluster, -1), fall


PART = "mass double, area double, run bigint, below double, late boolean, members array<bigint>"


def condense_in_bands(tree: DataFrame, weights: DataFrame, least: int, merge_below: float, limit: int) -> DataFrame:
    """(node, c, fall) as of condense(), for a forest of any size: a task holds some ``limit`` edges and the parts they join.

    The edges are cut into bands of ascending weight. One task climbs a band; the next band's edges
    then join the parts this one left, which carry their areas, runs and light nodes along.
    """
    bands = -(-2 * tree.count() // limit)  # of half the limit: ranges are cut by a sample
    rest = cut(tree.select("a", "b", "w", F.col("a").alias("oa"), F.col("b").alias("ob")).repartitionByRange(bands, "w", "oa", "ob").withColumn("band", F.spark_partition_id()))
    heavy = F.col("weight") >= least
    parts = cut(
        weights.select(
            "node", F.col("weight").cast("double").alias("mass"), F.when(heavy, F.col("weight") / FLOOR).otherwise(0.0).alias("area"),
            F.when(heavy, -2 - F.monotonically_increasing_id()).otherwise(F.lit(-1)).cast("bigint").alias("run"), F.lit(-np.inf).alias("below"),
            F.lit(False).alias("late"), F.when(heavy, F.expr("CAST(array() AS array<bigint>)")).otherwise(F.array("node")).alias("members"),
        )
    )
    left = [cut(parts.where(F.col("mass") >= least).select("node", "run", F.lit(FLOOR).alias("fall")))]
    closed: list[DataFrame] = []
    columns = ["mass", "area", "run", "below", "late", "members"]
    for band in range(bands):

        def step(frames: Iterator[pd.DataFrame], band: int = band) -> Iterator[pd.DataFrame]:
            got = [f for f in frames if len(f)]
            if not got:
                return
            e = pd.concat(got, ignore_index=True)
            is_part = e.kind.to_numpy() == "part"
            held, e = e[is_part].sort_values("a"), e[~is_part].sort_values(["w", "oa", "ob"])
            names = held.a.to_numpy()
            state = [list(p) for p in zip(*(held[c].tolist() for c in columns[:5]), (list(m) for m in held.members), strict=True)]
            root, out, ended = climb(state, np.searchsorted(names, e.a), np.searchsorted(names, e.b), e.w.to_numpy(), least, merge_below, (band + 1) << 32)
            blank = {"a": 0, "b": 0, "w": 0.0, "mass": 0.0, "area": 0.0, "run": -1, "below": 0.0, "late": False}
            for kind, rows in (
                ("left", {"a": [x[0] for x in out], "run": [x[1] for x in out], "w": [x[2] for x in out]}),
                ("closed", {"run": [x[0] for x in ended], "b": [x[1] for x in ended], "late": [x[2] for x in ended]}),
                ("moved", {"a": names, "b": names[root]}),
                ("part", {"a": names[(top := np.flatnonzero(root == np.arange(len(names))))], **{c: [state[r][k] for r in top] for k, c in enumerate(columns)}}),
            ):
                f = pd.DataFrame({"kind": kind, **rows})  # rows of any kind have all columns, filled with blanks
                f = f.assign(**{c: v for c, v in blank.items() if c not in rows})
                if "members" not in rows:
                    f["members"] = [[]] * len(f)
                if len(f):
                    yield f[["kind", "a", "b", "w", *columns]]

        now = rest.where(F.col("band") == band)
        ends = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        edges = now.select(F.lit("edge").alias("kind"), "a", "b", "w", "oa", "ob")
        zero = F.lit(0).cast("bigint")
        joint = parts.join(ends, "node", "left_semi").select(F.lit("part").alias("kind"), F.col("node").alias("a"), zero.alias("b"), F.lit(0.0).alias("w"), zero.alias("oa"), zero.alias("ob"), *columns)
        blanks = [F.lit(0.0).alias("mass"), F.lit(0.0).alias("area"), zero.alias("run"), F.lit(0.0).alias("below"), F.lit(False).alias("late"), F.expr("CAST(array() AS array<bigint>)").alias("members")]
        done = cut(joint.unionByName(edges.select("*", *blanks)).repartition(1).mapInPandas(step, f"kind string, a bigint, b bigint, w double, {PART}"))
        left.append(done.where("kind = 'left'").select(F.col("a").alias("node"), "run", F.col("w").alias("fall")))
        closed.append(done.where("kind = 'closed'").select("run", F.col("b").alias("by"), F.col("late").alias("chosen")))
        moved = done.where("kind = 'moved'").select(F.col("a").alias("node"), F.col("b").alias("root"))
        grown = cut(parts.join(moved, "node", "left_anti").unionByName(done.where("kind = 'part'").select(F.col("a").alias("node"), *columns)))
        later = rest.where(F.col("band") > band)
        for end in ("a", "b"):
            later = later.join(moved.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        later = cut(later)
        discard(parts)
        discard(rest)
        parts, rest = grown, later
    closed.append(parts.where(F.col("mass") >= least).select("run", F.lit(None).cast("bigint").alias("by"), (F.col("late") | (F.col("area") >= F.col("below"))).alias("chosen")))
    runs = closed[0]
    for f in closed[1:]:
        runs = runs.unionByName(f)
    # The topmost chosen cluster stands for those below: pointers jump to twice the height each time.
    runs = cut(runs.select("run", "by", F.when(F.col("chosen"), F.col("run")).alias("c")))
    while not runs.where("by IS NOT NULL").isEmpty():
        above = runs.select(F.col("run").alias("by"), F.col("by").alias("higher"), F.col("c").alias("above"))
        higher = cut(runs.join(above, "by", "left").select("run", F.col("higher").alias("by"), F.coalesce("above", "c").alias("c")))
        discard(runs)
        runs = higher
    out = left[0]
    for f in left[1:]:
        out = out.unionByName(f)
    return out.join(runs, "run").select("node", F.when(F.col("fall") <= merge_below, F.coalesce("c", F.lit(-1))).otherwise(F.lit(-1)).cast("bigint").alias("c"), "fall")


def cluster_curves(
    df: DataFrame,
    id_column: str = "curve_id",
    curve: str = "qe",
    least: int = 3,
    samples: int = 2,
    merge_below: float = 0.2,
    k: int = 6,
    rounds: int = 3,
    cell: float = 0.3,
    seed: int = 7,
    tree_limit: int = 100_000,
    hierarchy_limit: int = 100_000,
) -> DataFrame:
    """(id_column, cluster, persistence): one row per curve; cluster is the smallest id in it, NULL for an odd day.

    Distance is the root mean square difference of curves relative to their means. ``samples``:
    neighbours within the core distance; ``least``: curves a cluster has at least; ``merge_below``:
    scatter within which curves agree; persistence: 1 over the distance at which a curve leaves its
    cluster. Copies of a curve are one node that weighs as many. Curves without a shape (NULL,
    empty, mean zero) are odd.

    Distributed rounds contract the graph until ``tree_limit`` edges are left, of which one task
    finishes the spanning tree. The hierarchy is climbed in bands of ``hierarchy_limit`` edges at
    most, a task each; the clusters are the same in one band or many.
    """
    require(df, id_column, curve)
    members = cut(shape_table(df, id_column, curve))
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.first("shape").alias("shape"))
    near = neighbours(nodes, k, rounds, cell, seed)
    tree = cut(spanning_tree(reachability_graph(near, k, samples), tree_limit))
    weights = members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"))
    # Nodes and edges in one stream to one task: nodes as (node, NULL, weight).
    joint = tree.select("a", "b", "w").unionByName(weights.select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("weight").cast("double").alias("w")))

    def hierarchy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            e = pd.concat(got, ignore_index=True)
            is_node = e.b.isna().to_numpy()
            names = e.a.to_numpy()[is_node].astype(np.int64)
            mass = e.w.to_numpy()[is_node]
            by = np.argsort(names)
            names, mass = names[by], mass[by]
            a = np.searchsorted(names, e.a.to_numpy()[~is_node].astype(np.int64))
            b = np.searchsorted(names, e.b[~is_node].astype("int64").to_numpy())
            w = e.w.to_numpy()[~is_node]
            order = np.lexsort((b, a, w))  # equal weights come in the order of their nodes, as in bands
            c, fall = condense(len(names), a[order], b[order], w[order], mass, least, merge_below)
            yield pd.DataFrame({"node": names, "c": c, "fall": fall})

    # Node numbers are 64-bit: as text they pass through pandas without becoming floats.
    text = joint.select(F.col("a"), F.col("b").cast("string").alias("b"), "w")
    if tree.count() > hierarchy_limit:
        found = condense_in_bands(tree, weights, least, merge_below, hierarchy_limit)
    else:
        found = text.repartition(1).mapInPandas(hierarchy, "node bigint, c bigint, fall double")
    joined = members.select("id", "node").join(cut(found), "node", "left")
    names = joined.where("c <> -1").groupBy("c").agg(F.min("id").alias("cluster"))
    return joined.join(F.broadcast(names) if names.count() <= 100_000 else names, "c", "left").select(
        F.col("id").alias(id_column), "cluster", F.when(F.col("cluster").isNotNull(), 1 / F.greatest("fall", F.lit(1e-4))).alias("persistence")
    )


def describe_clusters(members: DataFrame, id_column: str = "curve_id", exemplars: int = 5) -> DataFrame:
    """(cluster, size, exemplars): the ids of each cluster's most persistent members, ties by id."""
    rank = F.struct((-F.col("persistence")).alias("p"), F.col(id_column).alias("id"))
    # Two steps of top-k: in a part of the cluster first, so that no list holds a whole cluster.
    part = members.where("cluster IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(64)))
    first = part.groupBy("cluster", "_salt").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(rank)), 1, exemplars).alias("top"))
    both = first.groupBy("cluster").agg(F.sum("n").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, exemplars).alias("top"))
    return both.select("cluster", "size", F.transform("top", lambda t: t["id"]).alias("exemplars"))


def pairs_together(pairs: DataFrame, members: DataFrame, id_column: str = "curve_id") -> DataFrame:
    """(curve_a, curve_b), smaller id first, of the pairs whose curves lie in the same cluster."""
    m = members.where("cluster IS NOT NULL").select(F.col(id_column).alias("_id"), "cluster")
    one = pairs.select("curve_a", "curve_b").join(m.select(F.col("_id").alias("curve_a"), F.col("cluster").alias("_ca")), "curve_a")
    two = one.join(m.select(F.col("_id").alias("curve_b"), F.col("cluster").alias("_cb")), "curve_b").where("_ca = _cb AND curve_a <> curve_b")
    return two.select(F.least("curve_a", "curve_b").alias("curve_a"), F.greatest("curve_a", "curve_b").alias("curve_b")).distinct()
