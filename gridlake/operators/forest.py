"""Random forests grown from sums per cell: rows alike in every feature's bin are drawn together and predicted once."""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.runtime import cut, discard

# Bins of a feature; levels of splits; rows a leaf holds at least: as Spark's own forests have them by default, but for the last.
BINS, DEPTH, LEAF = 32, 5, 6
# Cells of which a forest is grown at most; a tree's sums take 12 bytes each.
CELLS = 100_000
# Values of a feature that are all counted at most.
VALUES = 100_000
# Rows of a cell that one task draws from; trees grown by one task; rows times trees drawn by one task.
CELL_ROWS, BLOCK, DRAWS = 1_000_000, 10, 30_000_000


def thresholds(rows: DataFrame, column: str) -> list[np.ndarray]:
    """Each feature's bin edges over all rows: between all its values if they are few, else at its quantiles; x is left of an edge if x <= edge.

    Quantiles are exact for features of up to ``VALUES`` values, else off by a ten-thousandth of the rows at most.
    """
    each = rows.select(F.posexplode(column).alias("pos", "v"))
    points = [i / BINS for i in range(1, BINS)]
    found = {r["pos"]: r for r in each.groupBy("pos").agg(F.max("v").alias("top"), F.approx_count_distinct("v", 0.02).alias("n")).collect()}
    known, vast = [k for k, r in found.items() if r["n"] <= VALUES], [k for k, r in found.items() if r["n"] > VALUES]
    cuts = {}
    if known:
        counted = each.where(F.col("pos").isin(known)).groupBy("pos", "v").agg(F.count("*").alias("n"))
        firsts = F.slice(F.sort_array(F.collect_list("v")), 1, BINS + 1)
        cuts |= {r["pos"]: (r["q"], r["firsts"]) for r in counted.groupBy("pos").agg(F.percentile("v", points, F.col("n")).alias("q"), firsts.alias("firsts")).collect()}
    if vast:
        cuts |= {r["pos"]: (r["q"], []) for r in each.where(F.col("pos").isin(vast)).groupBy("pos").agg(F.percentile_approx("v", points, 10_000).alias("q")).collect()}
    out = []
    for pos, (quantiles, values) in sorted(cuts.items()):
        edges = np.add(values[:-1], values[1:]) / 2 if 0 < len(values) <= BINS else np.unique([q for q in quantiles if q < found[pos]["top"]])
        out.append(edges[np.isfinite(edges)].astype(float))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.uint8)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def drawn(y: np.ndarray, trees: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Per tree, how many rows of a bootstrap fall on these and the sum of their y.

    A row comes up Poisson(1) times in each tree; so Poisson(n) of n rows come up, each any of them.
    """
    n = rng.poisson(len(y), trees)
    s = np.zeros(trees)
    step = max(1, 1_000_000 // len(y))
    for a in range(0, trees, step):
        own = n[a : a + step]
        some = own > 0
        if some.any():
            picked = y[rng.integers(0, len(y), own.sum(), dtype=np.uint32)]
            s[a : a + step][some] = np.add.reduceat(picked, (np.cumsum(own) - own)[some])
    return n.astype(np.uint32), s


def grown(bins: np.ndarray, sizes: list[int], n: np.ndarray, s: np.ndarray, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin to the left) per inner node and the mean per leaf of a tree of DEPTH levels; node i has the children 2i+1 and 2i+2.

    Each node tries ``tried`` features and takes the split that lowers the variance most. A node
    that isn't split hands everything to its left child.
    """
    feature, last = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, BINS, np.int32)
    at, live = np.zeros(len(bins), np.int64), np.ones(1, bool)
    every = np.arange(len(bins))
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        mine, node = at - first, np.arange(width)
        total, mass = np.bincount(mine, n, width), np.bincount(mine, s, width)
        asked = np.zeros((width, len(sizes)), bool)
        np.put_along_axis(asked, np.argsort(rng.random(asked.shape), 1)[:, :tried], True, 1)
        best, which, where = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            k = mine * size + bins[:, f]
            nl, sl = (np.cumsum(np.bincount(k, w, width * size).reshape(width, size), 1)[:, :-1] for w in (n, s))
            nr, sr = total[:, None] - nl, mass[:, None] - sl
            ok = (nl >= LEAF) & (nr >= LEAF) & (asked[:, f] & live)[:, None]
            gain = np.where(ok, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - (mass**2 / np.maximum(total, 1))[:, None], -np.inf)
            j = gain.argmax(1)
            better = gain[node, j] > best
            best, which, where = np.where(better, gain[node, j], best), np.where(better, f, which), np.where(better, j, where)
        live = which >= 0
        feature[first + node[live]], last[first + node[live]] = which[live], where[live]
        at = 2 * at + 1 + (bins[every, feature[at]] > last[at])
        live = np.repeat(live, 2)
    at -= 2**DEPTH - 1
    total = np.bincount(at, n, 2**DEPTH)
    return feature, last, np.bincount(at, s, 2**DEPTH) / np.maximum(total, 1)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A forest's bin edges and trees. Each task predicts a cell once, whatever the number of its rows."""

    state = Param(Params._dummy(), "state", "edges and trees, compressed", TypeConverters.toString)

    @staticmethod
    def of(edges: list[np.ndarray], feature: np.ndarray, last: np.ndarray, mean: np.ndarray) -> ForestModel:
        out = io.BytesIO()
        np.savez_compressed(out, feature=feature, last=last, mean=mean, width=len(edges), **{f"e{i}": e for i, e in enumerate(edges)})
        model = ForestModel()
        return model._set(state=base64.b64encode(out.getvalue()).decode())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.getOrDefault(self.state)

        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = np.load(io.BytesIO(base64.b64decode(state)))
            feature, last, mean = held["feature"], held["last"], held["mean"]
            edges = [held[f"e{i}"] for i in range(int(held["width"]))]
            inner, leaves, trees = feature.shape[1], mean.shape[1], np.arange(len(feature))
            feature, last, mean = feature.ravel(), last.ravel(), mean.ravel()

            def of_cells(bins: np.ndarray) -> np.ndarray:
                out = np.empty(len(bins))
                for a in range(0, len(bins), 1024):
                    part = bins[a : a + 1024]
                    row, at = np.arange(len(part))[:, None] * len(edges), np.zeros((len(part), len(trees)), np.int64)
                    while at[0, 0] < inner:
                        node = at + trees * inner
                        at = 2 * at + 1 + (part.take(row + feature.take(node)) > last.take(node))
                    out[a : a + 1024] = mean.take(at - inner + trees * leaves).mean(1)
                return out

            known: dict[bytes, float] = {}
            for batch in batches:
                if not len(batch):
                    yield pa.array([], pa.float64())
                    continue
                bins = np.ascontiguousarray(binned(matrix(batch, len(edges)), edges))
                cells, begin, of = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
                names = [c.tobytes() for c in cells]
                new = np.array([i for i, c in enumerate(names) if c not in known], np.int64)
                known.update(zip((names[i] for i in new), of_cells(bins[begin[new]]), strict=True))
                yield pa.array(np.array([known[c] for c in names])[of])

        # Not deterministic to the optimiser, else a filter on the prediction would predict all over again.
        udf = F.arrow_udf(predict, "double").asNondeterministic()
        return dataset.withColumn(self.getPredictionCol(), udf(vector_to_array(F.col(self.getFeaturesCol()))))


def grow(df: DataFrame, features: str, target: str, trees: int, seed: int) -> ForestModel | None:
    """A forest of all rows, or None if they have more than CELLS different cells (or there are none).

    A tree sees nothing of a row but its bins and its target, so the bootstrap is drawn per cell and
    only its sums move on, to the tasks that grow the trees. Draws depend on the cell, its sorted
    targets and the seed, not on how the rows are spread.
    """
    x = cut(df.select(vector_to_array(F.col(features)).alias("x"), F.col(target).cast("double").alias("y")))
    edges = thresholds(x, "x")
    if not edges:
        discard(x)
        return None
    width = len(edges)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.ascontiguousarray(binned(matrix(b.column("x"), width), edges))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(width), len(bins), [None, pa.py_buffer(bins)]).cast(pa.binary()), b.column("y")], ["cell", "y"])

    rows = cut(x.mapInArrow(to_cells, "cell binary, y double"))
    discard(x)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    cells, n, s = counts.agg(F.count("*"), F.sum("n"), F.sum("s")).first()
    if cells > CELLS:
        discard(rows)
        return None
    mean = float(f"{s / n:.6g}")  # only centres the sums; rounded, it doesn't depend on the order of adding up
    # A cell of very many rows is drawn by several tasks, each from the rows of some of the table's splits.
    salt = F.lit(0)
    for r in counts.where(F.col("n") > CELL_ROWS).collect():
        salt = F.when(F.col("cell") == F.lit(bytes(r["cell"])), F.pmod(F.spark_partition_id(), F.lit(-(-r["n"] // CELL_ROWS)))).otherwise(salt)
    parts = int(max(1, n * trees // DRAWS, cells * trees // 5_000_000))
    lists = rows.select(F.struct("cell", salt.alias("salt")).alias("of"), "y").repartition(parts, "of").groupBy("of").agg(F.sort_array(F.collect_list("y")).alias("y")).select("of.*", "y")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, k, y in zip(b.column("cell").to_pylist(), b.column("salt").to_pylist(), b.column("y"), strict=True):
                got, total = drawn(y.values.to_numpy(zero_copy_only=False) - mean, trees, np.random.default_rng([seed, k, int.from_bytes(cell, "little")]))
                at = range(0, trees, BLOCK)
                columns = [[i // BLOCK for i in at], [cell] * len(at), [got[i : i + BLOCK].tobytes() for i in at], [total[i : i + BLOCK].tobytes() for i in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "cell", "n", "s"])

    sizes, tried = [len(e) + 1 for e in edges], int(np.ceil(np.sqrt(width)))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending")])  # sums of doubles depend on their order
        block = table.column("block")[0].as_py()
        bins = np.frombuffer(b"".join(table.column("cell").to_pylist()), np.uint8).reshape(-1, width)
        n, s = (np.frombuffer(b"".join(table.column(c).to_pylist()), t).reshape(len(bins), -1) for c, t in (("n", np.uint32), ("s", np.float64)))
        made = [grown(bins, sizes, n[:, i].astype(float), s[:, i], tried, np.random.default_rng([seed, block * BLOCK + i])) for i in range(n.shape[1])]
        return pa.table({"tree": pa.array([block * BLOCK + i for i in range(len(made))], pa.int32()), **{c: pa.array([t[j].tobytes() for t in made], pa.binary()) for j, c in enumerate(("feature", "last", "mean"))}})

    blocks = -(-trees // BLOCK)
    made = lists.mapInArrow(draw, "block int, cell binary, n binary, s binary").repartition(blocks, "block").groupBy("block").applyInArrow(build, "tree int, feature binary, last binary, mean binary")
    found = sorted(made.collect(), key=lambda r: r["tree"])  # some hundreds of bytes a tree
    discard(rows)
    feature, last, leaf = (np.stack([np.frombuffer(r[c], t) for r in found]) for c, t in (("feature", np.int32), ("last", np.int32), ("mean", np.float64)))
    return ForestModel.of(edges, feature, last, leaf + mean)
