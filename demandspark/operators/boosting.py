"""Direct multi-step boosted trees, grown on histograms for all steps (and folds) at once.

Features are cut into bins once; a block of rows is its bins (a byte a feature), the targets of all
models, a hash of each row's key and the margins. Every tree level is one pass over the blocks: each
partition sums gradients, hessians and rows by model, node, feature and bin, only these sums are shuffled,
by feature, and added up (their size does not depend on the rows). Splits are chosen there: the driver
gets a few numbers a node and task.
All steps share the passes: 200 rounds of depth 6 are 1,200 passes for any number of models.

Gradients are rounded to multiples of 2^-20, so sums are exact and a model does not depend on partitions.
Margins of a round come from those of the round before; every few rounds they are computed from the
stored blocks and all trees instead, which keeps lineages short without any state that could be lost.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.columns import check_frequency, clip_at_zero, future_period
from demandspark.operators.folds import assign_folds
from demandspark.operators.reshape import keep_ids
from demandspark.operators.stockout import STRATEGIES, correct_stockouts, stockout_stats
from demandspark.operators.windows import latest_per_series, lead_targets
from demandspark.schemas import IMPORTANCE, SEED
from demandspark.sources.storage import cut_lineage, require

OBJECTIVES = ("l1", "l2", "tweedie")

# Missing features get a bin of their own on the low side: features are sales, counts, flags and
# calendar numbers, all >= 0.
MISSING = -1.0

#: Rows of a block and partition at most, and at least while there are idle cores.
ROWS_PER_PARTITION, ROWS_WORTH_A_TASK = 250_000, 16_384
UNIT = float(1 << 20)
#: Residual bins of a leaf, for medians under the absolute loss.
RESIDUAL_BINS = 512


@dataclass(frozen=True)
class BoostingSettings:
    rounds: int = 200
    step_size: float = 0.05
    max_depth: int = 6
    min_rows: int = 20
    min_hessian: float = 1e-3
    feature_fraction: float = 0.8
    row_fraction: float = 0.8
    max_bins: int = 64
    checkpoint_rounds: int = 20
    tweedie_power: float = 1.5
    seed: int = SEED
    # rows, drawn by a hash of their key, from which bin edges and the l1 starting point are taken
    bin_rows: int = 50_000


@dataclass
class TreeModel:
    """A boosted ensemble of complete trees: split feature and bin of every inner node, leaf values."""

    edges: list[np.ndarray]
    base: float
    link: str
    features: np.ndarray  # rounds x inner nodes
    bins: np.ndarray
    leaves: np.ndarray  # rounds x leaves
    gains: np.ndarray  # a number a feature

    def margins(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.base)
        for f, b, leaf in zip(self.features, self.bins, self.leaves, strict=True):
            out += leaf[leaf_of(binned, f, b)]
        return out

    def predict(self, binned: np.ndarray) -> np.ndarray:
        margins = self.margins(binned)
        return np.exp(np.clip(margins, -30, 30)) if self.link == "log" else margins

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        size = np.array([len(e) for e in self.edges])
        flat = np.concatenate(self.edges) if self.edges else np.zeros(0)
        np.savez_compressed(
            out, size=size, flat=flat, base=self.base, link=self.link, features=self.features, bins=self.bins, leaves=self.leaves, gains=self.gains
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> TreeModel:
        f = np.load(io.BytesIO(data))
        edges = np.split(f["flat"], np.cumsum(f["size"])[:-1])
        return cls(edges, float(f["base"]), str(f["link"]), f["features"], f["bins"], f["leaves"], f["gains"])


def leaf_of(binned: np.ndarray, features: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Leaf of every row in a complete tree given as arrays over its inner nodes."""
    return node_at(binned, features, bins, int(math.log2(len(features) + 1)))


def node_at(binned: np.ndarray, features: np.ndarray, bins: np.ndarray, level: int) -> np.ndarray:
    """Place of every row among the nodes of a level."""
    rows, at = np.arange(len(binned)), np.zeros(len(binned), np.int64)
    for d in range(level):
        node = at + (1 << d) - 1
        at = 2 * at + (binned[rows, features[node]] > bins[node])
    return at


def vector(feature_cols: Sequence[str]):
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in feature_cols))


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of edges below it."""
    out = np.empty(x.shape, np.uint8, order="F")
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def bin_edges(sample: np.ndarray, most: int) -> list[np.ndarray]:
    """Edges of at most ``most`` bins a feature: between all values if they are few, else by quantiles."""
    edges = []
    for j in range(sample.shape[1]):
        values = np.unique(sample[:, j])
        if len(values) > most:
            values = np.unique(np.quantile(sample[:, j], np.linspace(0, 1, most + 1)[1:-1], method="lower"))
            edges.append(values)
        else:
            edges.append(values[:-1])
    return edges


def uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """A number in [0, 1) for every key hash and the given number."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def gradients(objective: str, y: np.ndarray, margin: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    if objective == "l2":
        return margin - y, np.ones_like(y)
    if objective == "l1":
        return np.sign(margin - y), np.ones_like(y)
    margin = np.clip(margin, -30, 30)
    low, high = np.exp((1 - power) * margin), np.exp((2 - power) * margin)
    return high - y * low, (2 - power) * high - (1 - power) * y * low


@dataclass
class _Block:
    bins: np.ndarray
    y: np.ndarray  # rows x models, NaN: not a training row of the model
    key: np.ndarray
    margin: np.ndarray


def _squash(residual: np.ndarray) -> np.ndarray:
    """Bin of a residual, finer near zero."""
    half = RESIDUAL_BINS // 2
    return (half + np.clip(np.round(np.arcsinh(residual * 8) * 16), -half, half - 1)).astype(np.int64)


def _unsquash(place: np.ndarray) -> np.ndarray:
    return np.sinh((place - RESIDUAL_BINS // 2) / 16) / 8


def _best(place: int, hist: np.ndarray, s: BoostingSettings) -> np.ndarray:
    """Of one feature, every node's split of most gain: gain, place of the feature, bin, gradient and hessian of
    the left child, gradient and hessian of the node."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = hist.sum(axis=2)[:, :, None]
    right = whole - left
    fit = (left[2] >= s.min_rows) & (right[2] >= s.min_rows)
    fit &= (left[1] >= s.min_hessian) & (right[1] >= s.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
    gain = np.where(fit, gain, 0.0)
    out = np.zeros((7, len(gain)))
    out[1], out[5:] = place, whole[:2, :, 0]
    if gain.shape[1]:
        n, c = np.arange(len(gain)), gain.argmax(axis=1)
        out[0], out[2], out[3:5] = gain[n, c], c, left[:2, n, c]
    return out


def _better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Node by node the split of more gain; of equal ones that of the earlier feature."""
    return np.where((a[0] > b[0]) | ((a[0] == b[0]) & (a[1] < b[1])), a, b)


class _Growth:
    """Grows the trees of all models over the blocks."""

    def __init__(self, blocks: RDD, names: list[str], edges: list[np.ndarray], bases: np.ndarray, objective: str, s: BoostingSettings):
        self.blocks, self.names, self.edges, self.bases = blocks, names, edges, bases
        self.objective, self.s = objective, s
        self.width = max((len(e) for e in edges), default=0) + 1
        m, inner = len(names), (1 << s.max_depth) - 1
        self.features = np.zeros((0, m, inner), np.int16)
        self.bins = np.zeros((0, m, inner), np.uint8)
        self.leaves = np.zeros((0, m, inner + 1))
        self.gains = np.zeros((m, len(edges)))

    # ---- passes over the blocks

    def _margins(self, r: int, before: RDD | None) -> RDD:
        """Blocks with the margins after ``r`` rounds."""
        first = 0 if before is None or r % self.s.checkpoint_rounds == 0 else r - 1
        trees = [(self.features[t], self.bins[t], self.leaves[t]) for t in range(first, r)]
        bases, afresh = self.bases, first == 0

        def move(b: _Block) -> _Block:
            margin = np.tile(bases, (len(b.bins), 1)) if afresh else b.margin.copy()
            for f, c, leaf in trees:
                for k in range(margin.shape[1]):
                    margin[:, k] += leaf[k][leaf_of(b.bins, f[k], c[k])]
            return _Block(b.bins, b.y, b.key, margin)

        return (self.blocks if afresh else before).map(move).persist(StorageLevel.MEMORY_AND_DISK)

    def _sums(self, part, blocks: RDD) -> RDD:
        """By number: the arrays that ``part`` makes of each block, added up. The sums of a partition go to as many
        tasks as there are partitions, by their number, and stay there."""

        def run(rows: Iterator[_Block]) -> Iterator[tuple[int, np.ndarray]]:
            total = None
            for b in rows:
                total = part(b) if total is None else total + part(b)
            return iter(()) if total is None else enumerate(total)

        return blocks.mapPartitions(run).reduceByKey(np.add, blocks.getNumPartitions())

    def _histograms(self, state: RDD, r: int, level: int, tree, numbers: np.ndarray, columns: np.ndarray) -> RDD:
        """Of every drawn feature, by its place: gradient, hessian and row sums by node and bin. ``numbers`` has the
        number of each model's nodes of the level, -1 for those that are not summed."""
        s, objective, width = self.s, self.objective, self.width
        many, kinds = int(numbers.max()) + 1, 3 if objective == "tweedie" else 2
        features, bins = tree

        def part(b: _Block) -> np.ndarray:
            size = many * width
            out = np.zeros((len(columns), kinds, size))
            drawn = uniform(b.key, s.seed + r) < s.row_fraction if s.row_fraction < 1 else np.ones(len(b.key), bool)
            held = []
            for k in range(b.y.shape[1]):
                at = node_at(b.bins, features[k], bins[k], level)
                place = numbers[k][at]
                rows = np.flatnonzero(drawn & ~np.isnan(b.y[:, k]) & (place >= 0))
                if not len(rows):
                    continue
                g, h = gradients(objective, b.y[rows, k], b.margin[rows, k], s.tweedie_power)
                held.append((rows, place[rows] * width, np.rint(g * UNIT), np.rint(h * UNIT)))
            if not held:
                return out
            rows, first, g, h = (np.concatenate(v) for v in zip(*held, strict=True))
            for i, j in enumerate(columns):
                cells = first + b.bins[:, j][rows]
                out[i, 0] = np.bincount(cells, g, size)
                if kinds == 3:
                    out[i, 1] = np.bincount(cells, h, size)
                out[i, -1] = np.bincount(cells, minlength=size)
            return out

        def whole(sums: np.ndarray) -> np.ndarray:
            found = sums.reshape(kinds, many, width)
            return np.stack([found[0] / UNIT, found[1] / UNIT if kinds == 3 else found[-1], found[-1]])

        return self._sums(part, state).mapValues(whole)

    def _medians(self, state: RDD, tree) -> np.ndarray:
        """Median residual of every model's leaf, from counts in bins that are finer near zero."""
        features, bins = tree
        leaves = features.shape[1] + 1

        def part(b: _Block) -> np.ndarray:
            out = np.zeros((b.y.shape[1], leaves * RESIDUAL_BINS))
            for k in range(b.y.shape[1]):
                rows = np.flatnonzero(~np.isnan(b.y[:, k]))
                at = leaf_of(b.bins[rows], features[k], bins[k])
                out[k] += np.bincount(at * RESIDUAL_BINS + _squash(b.y[rows, k] - b.margin[rows, k]), minlength=out.shape[1])
            return out

        def middle(sums: np.ndarray) -> np.ndarray:
            counts = sums.reshape(leaves, RESIDUAL_BINS)
            half = counts.sum(axis=1, keepdims=True) / 2
            place = (np.cumsum(counts, axis=1) < half).sum(axis=1)
            return np.where(half[:, 0] > 0, _unsquash(np.minimum(place, RESIDUAL_BINS - 1)), 0.0)

        found = dict(self._sums(part, state).mapValues(middle).collect())
        return np.stack([found[k] for k in range(len(self.names))])

    # ---- trees

    def _split(self, hist: RDD) -> np.ndarray:
        """Best split of each node, chosen where the sums are: rows as of :func:`_best`."""
        s = self.s

        def run(features: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
            best = None
            for place, sums in features:
                found = _best(place, sums, s)
                best = found if best is None else _better(best, found)
            return iter(()) if best is None else iter((best,))

        return reduce(_better, hist.mapPartitions(run).collect())

    def _tree(self, state: RDD, r: int) -> None:
        s, m = self.s, len(self.names)
        inner = (1 << s.max_depth) - 1
        features, bins = np.zeros((m, inner), np.int16), np.full((m, inner), 255, np.uint8)
        rng = np.random.default_rng([s.seed, r])
        count = max(1, math.ceil(s.feature_fraction * len(self.edges)))
        columns = np.sort(rng.choice(len(self.edges), count, replace=False))
        value = np.zeros((m, 1))  # leaf value of every node of the level
        nodes = [(k, 0) for k in range(m)]  # (model, place) of the nodes that may be cut
        for level in range(s.max_depth):
            numbers = np.full((m, 1 << level), -1)
            numbers[tuple(np.transpose(nodes))] = np.arange(len(nodes))
            best = self._split(self._histograms(state, r, level, (features, bins), numbers, columns))
            gain, f, c = np.where(best[0] > 1e-9, best[0], 0.0), columns[best[1].astype(int)], best[2].astype(int)
            low, totals = best[3:5], best[5:7]
            if not level:
                value[:, 0] = -totals[0] / np.maximum(totals[1], 1e-12)
            high = totals - low
            wider = np.repeat(value, 2, axis=1)
            cut = []
            for i, (k, place) in enumerate(nodes):
                if gain[i] <= 0:
                    continue
                node = place + (1 << level) - 1
                features[k, node], bins[k, node] = f[i], c[i]
                self.gains[k, f[i]] += gain[i]
                wider[k, 2 * place], wider[k, 2 * place + 1] = -low[0, i] / low[1, i], -high[0, i] / high[1, i]
                cut.append(i)
            value = wider
            if not cut or level + 1 == s.max_depth:
                if not cut:
                    value = np.repeat(value, 1 << (s.max_depth - level - 1), axis=1)
                break
            nodes = [(nodes[i][0], 2 * nodes[i][1]) for i in cut] + [(nodes[i][0], 2 * nodes[i][1] + 1) for i in cut]
        if self.objective == "l1":
            value = self._medians(state, (features, bins))
        self.features = np.concatenate([self.features, features[None]])
        self.bins = np.concatenate([self.bins, bins[None]])
        self.leaves = np.concatenate([self.leaves, s.step_size * value[None]])

    def run(self) -> dict[str, TreeModel]:
        state = None
        for r in range(self.s.rounds):
            moved = self._margins(r, state)
            self._tree(moved, r)  # the first pass fills the cache
            if state is not None:
                state.unpersist()
            state = moved
        if state is not None:
            state.unpersist()
        link = "log" if self.objective == "tweedie" else "identity"
        return {
            name: TreeModel(
                self.edges, float(self.bases[k]), link, self.features[:, k], self.bins[:, k], self.leaves[:, k], self.gains[k]
            )
            for k, name in enumerate(self.names)
        }


def grow(
    rows: DataFrame, feature_cols: Sequence[str], targets: Sequence[str], objective: str, s: BoostingSettings, edge_rows: DataFrame | None = None
) -> dict[str, TreeModel]:
    """One model a target column of ``rows`` (``id, date``, features, targets; NULL target: not a training row).

    Targets without any value get no model. Bin edges come from ``edge_rows`` (default: ``rows``).
    """
    spark, width = rows.sparkSession, len(feature_cols)
    key = F.xxhash64(F.lit(s.seed), "id", "date")
    data = rows.select("id", key.alias("key"), vector(feature_cols).alias("x"), *(F.col(t).cast("double").alias(t) for t in targets))
    found = data.agg(F.count(F.lit(1)).alias("_n"), *[F.count(t).alias(t) for t in targets], *[F.avg(t).alias(f"mean_{t}") for t in targets]).first()
    names = [t for t in targets if found[t]]
    if not names:
        return {}
    drawn = data if edge_rows is None else edge_rows.select(key.alias("key"), vector(feature_cols).alias("x"), *(F.lit(None).cast("double").alias(t) for t in targets))
    share = s.bin_rows / max(1, found["_n"])
    drawn = drawn if share >= 1 else drawn.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.select("x", *names).toArrow()
    edges = bin_edges(matrix_of(sample.column("x").combine_chunks(), width), s.max_bins)
    means = np.array([found[f"mean_{t}"] for t in names])
    if objective == "l1":
        middle = [np.median(v) if len(v) else m for v, m in ((sample.column(t).drop_null().to_numpy(), m) for t, m in zip(names, means, strict=True))]
        bases = np.array(middle)
    else:
        bases = np.log(np.maximum(means, 1e-6)) if objective == "tweedie" else means

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            x, y, k = (np.concatenate(parts) for parts in zip(*held, strict=True))
            cells = [x.tobytes("F"), y.tobytes(), k.tobytes()]  # bins feature by feature
            return pa.RecordBatch.from_arrays([pa.array([len(k)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["n", "bins", "y", "key"])

        for batch in batches:
            x = binned(matrix_of(batch.column("x"), width), edges)
            y = np.stack([batch.column(t).to_numpy(zero_copy_only=False).astype(np.float64) for t in names], axis=1)
            held.append((x, y, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)))
            size += len(x)
            if size >= ROWS_PER_PARTITION:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    cores = spark.sparkContext.defaultParallelism
    parts = max(math.ceil(found["_n"] / ROWS_PER_PARTITION), min(cores, math.ceil(found["_n"] / ROWS_WORTH_A_TASK)))
    # by the hash of the row: a hot series spreads, and the exchange is not dropped for one by id below it
    packed = data.repartition(parts, "key").mapInArrow(pack, "n int, bins binary, y binary, key binary")
    packed = cut_lineage(packed)
    models = len(names)

    def unpack(row) -> _Block:
        bins = np.frombuffer(row.bins, np.uint8).reshape((row.n, width), order="F")
        return _Block(bins, np.frombuffer(row.y).reshape(row.n, models), np.frombuffer(row.key, np.uint64), np.zeros((row.n, 0)))

    blocks = packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _Growth(blocks, names, edges, bases, objective, s).run()
    finally:
        blocks.unpersist()


@dataclass
class BoostedForecast:
    """Fitted models by step, with the rows they predict from."""

    name: str
    feature_cols: list[str]
    horizon: int
    frequency: str
    models: dict[int, TreeModel]
    latest: DataFrame
    stats: DataFrame | None
    last_date: object = None

    def predict(self, horizon: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """Predictions for the next ``horizon`` periods from each series' latest row."""
        horizon = self.horizon if horizon is None else horizon
        if not 1 <= horizon <= self.horizon:
            raise ValueError(f"models are trained for steps 1 to {self.horizon}, not {horizon}")
        rows = self.latest if ids is None else keep_ids(self.latest, ids)
        models = {h: m.to_bytes() for h, m in self.models.items()}
        width = len(self.feature_cols)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {h: TreeModel.from_bytes(m) for h, m in models.items()}
            for batch in batches:
                x = matrix_of(batch.column("x"), width)
                for h in range(1, horizon + 1):
                    found = loaded[h].predict(binned(x, loaded[h].edges)) if h in loaded else np.full(len(x), np.nan)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(np.full(len(x), h, np.int32)), pa.array(found)], ["id", "step", "prediction"]
                    )

        scored = rows.select("id", vector(self.feature_cols).alias("x")).mapInArrow(run, "id string, step int, prediction double")
        date = future_period(F.lit(self.last_date), F.col("step"), self.frequency)
        return scored.select("id", date.alias("date"), clip_at_zero(F.col("prediction")).alias("prediction"))

    def feature_importance(self) -> DataFrame:
        """Mean normalised gain over the steps, largest first."""
        shares = [m.gains / m.gains.sum() if m.gains.sum() > 0 else m.gains for m in self.models.values()]
        totals = np.mean(shares, axis=0) if shares else np.zeros(len(self.feature_cols))
        rows = list(zip(self.feature_cols, totals.tolist(), strict=True))
        return self.latest.sparkSession.createDataFrame(rows, IMPORTANCE).orderBy(F.desc("importance"), "feature")

    def save_models(self, path: str) -> None:
        rows = [(h, m.to_bytes()) for h, m in sorted(self.models.items())]
        spark = self.latest.sparkSession
        spark.createDataFrame(rows, "step int, model binary").repartition(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[int, TreeModel]:
    require(spark, path)
    rows = spark.read.schema("step int, model binary").parquet(path).orderBy("step").collect()  # a row a step
    return {r["step"]: TreeModel.from_bytes(r["model"]) for r in rows}


@dataclass
class BoostedForecaster:
    """Settings of a boosted forecaster; ``fit`` grows one model per horizon step, all in the same passes.

    ``objective`` is ``l1``, ``l2`` or ``tweedie``. ``target_correction`` imputes stockouts in the
    training target only; the test target is never touched.
    """

    feature_cols: Sequence[str]
    horizon: int
    objective: str
    frequency: str = "W"
    target_correction: str = "none"
    settings: BoostingSettings = field(default_factory=BoostingSettings)

    def __post_init__(self) -> None:
        check_frequency(self.frequency)
        if self.objective not in OBJECTIVES:
            raise ValueError(f"objective must be one of {sorted(OBJECTIVES)}, not {self.objective!r}")
        if self.target_correction not in STRATEGIES:
            raise ValueError(f"target_correction must be one of {STRATEGIES}")
        if not self.feature_cols:
            raise ValueError("at least one feature column is needed")

    @property
    def name(self) -> str:
        parts = ["" if self.objective == "l1" else self.objective]
        if self.target_correction != "none":
            parts.append(f"corr-{self.target_correction}")
        return "-".join(["BoostedTrees", *[p for p in parts if p]])

    def training_rows(self, train: DataFrame) -> DataFrame:
        """The rows with the corrected target of every step, ``target_h1`` and so on."""
        if self.target_correction != "none":
            train = correct_stockouts(train, self.target_correction)
        return lead_targets(train, self.horizon)

    def _check(self, train: DataFrame) -> list[str]:
        absent = sorted(set(self.feature_cols) - set(train.columns))
        if absent:
            raise ValueError(f"feature columns are missing: {absent}")
        return [f"target_h{h}" for h in range(1, self.horizon + 1)]

    def _forecast(self, train: DataFrame, models: dict[int, TreeModel], stats: DataFrame | None, end: object) -> BoostedForecast:
        latest = latest_per_series(train, "id", "date", self.feature_cols)
        return BoostedForecast(self.name, list(self.feature_cols), self.horizon, self.frequency, models, latest, stats, end)

    def fit(self, train: DataFrame) -> BoostedForecast:
        targets = self._check(train)
        stats = stockout_stats(train, self.target_correction)
        found = grow(self.training_rows(train), self.feature_cols, targets, self.objective, self.settings)
        models = {h: found[t] for h, t in enumerate(targets, start=1) if t in found}
        end = train.agg(F.max("date").alias("d")).first()["d"]
        return self._forecast(train, models, stats, end)

    def fit_folds(self, matrix: DataFrame, folds: DataFrame) -> dict[int, BoostedForecast]:
        """One forecast per fold that has training rows; the models of all folds and steps share their passes.

        Targets are corrected and looked up within each fold's training rows; bin edges come from the rows
        that every fold may see.
        """
        targets = self._check(matrix)
        table = folds.orderBy("fold_id").collect()  # a handful of rows
        rows = assign_folds(matrix.select("id", "date", "sales"), folds).where("role = 'train'")
        # a series of one fold is a series of its own
        own = F.concat(F.col("fold_id").cast("string"), F.lit("|"), "id")
        long = self.training_rows(rows.select(own.alias("id"), F.col("id").alias("series"), "fold_id", "date", "sales"))
        columns = {f"f{r['fold_id']}_{t}": (r["fold_id"], t) for r in table for t in targets}
        wide = long.groupBy(F.col("series").alias("id"), "date").agg(
            *(F.max(F.when(F.col("fold_id") == k, F.col(t))).alias(c) for c, (k, t) in columns.items())
        )
        wide = matrix.select("id", "date", *self.feature_cols).join(wide, ["id", "date"])
        seen = matrix.where(F.col("date") <= min(r["train_end"] for r in table)) if table else matrix
        found = grow(wide, self.feature_cols, list(columns), self.objective, self.settings, seen)
        out = {}
        for r in table:
            models = {h: found[c] for h, t in enumerate(targets, start=1) if (c := f"f{r['fold_id']}_{t}") in found}
            train = matrix.where(F.col("date") <= r["train_end"])
            end = train.agg(F.max("date").alias("d")).first()["d"]
            if end is not None:
                out[r["fold_id"]] = self._forecast(train, models, None, end)
        return out
