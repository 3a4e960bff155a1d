"""Cross-products of wide designs, kept as square tiles.

The matrix of cross-products of p columns is a table with one row per pair of column blocks: ``(bi, bj, n, mean_i,
mean_j, cp)`` with ``bi <= bj`` and ``cp`` the centred products, row by row. No task and no row ever holds all of it:
a task adds up the tiles of one *strip* of the triangle, at most ``STRIP_BYTES``, and a design whose tiles need more
is read once per strip. Correlations and principal components are computed from the tiles where they lie; the driver
sees p x k numbers for k components, never p x p.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage

BLOCK = 256
STRIP_BYTES = 1 << 27
SALTS = 64
TILE = "bi int, bj int, n bigint, mean_i array<double>, mean_j array<double>, cp array<double>"


def vectors(df: DataFrame, cols: list[str] | str, width: int | None = None) -> tuple[DataFrame, int]:
    """One array column ``_x`` of the rows where every value is present (neither NULL nor NaN), and its length.

    ``cols`` lists columns, or names one array column of ``width`` numbers; an array of another length is an error.
    """
    if isinstance(cols, str):
        if width is None:
            raise ValueError("an array column needs its width")
        x = F.col(f"`{cols}`").cast("array<double>")
        x = F.when(F.size(x) == width, x).when(x.isNotNull(), F.raise_error(F.lit(f"an array does not have {width} values")))
    else:
        x, width = F.array(*[F.col(f"`{c}`").cast("double") for c in cols]), len(cols)
    return df.select(x.alias("_x")).where(F.col("_x").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))), width


def strips(width: int, block: int = BLOCK, limit: int = STRIP_BYTES) -> list[list[tuple[int, int]]]:
    """The tiles of the upper triangle in groups that fit into ``limit`` bytes, one tile at least."""
    blocks = -(-width // block)
    each = max(1, limit // (8 * min(block, max(width, 1)) ** 2))
    tiles = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    return [tiles[at:at + each] for at in range(0, len(tiles), each)]


def tiled_gram(df: DataFrame, cols: list[str] | str, width: int | None = None, block: int = BLOCK, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """The tiles of ``df``, staged. Rows that lack a value are left out; without rows there are no tiles.

    Each task sends one row per tile of its strip. These are merged by tile in two levels as they stream by, so
    that the parts of a tile from all tasks do not meet in one task first.
    """
    rows, width = vectors(df, cols, width)
    made = None
    for strip in strips(width, block, strip_bytes):
        one = rows.mapInArrow(_partial(strip, width, block), TILE + ", _salt int")
        made = one if made is None else made.unionAll(one)
    if made is None:
        raise ValueError("a design needs at least one column")
    for keys in (["bi", "bj", "_salt"], ["bi", "bj"]):
        made = made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(len(keys) == 3), TILE + (", _salt int" if len(keys) == 3 else ""))
    return stage(made, "tiles")


def _batch(tiles: list[tuple], salted: bool) -> pa.RecordBatch:
    """Tiles (bi, bj, n, mean_i, mean_j, cp, salt) as rows."""
    columns = list(zip(*tiles))
    numbers = pa.list_(pa.float64())
    data = {"bi": pa.array(columns[0], pa.int32()), "bj": pa.array(columns[1], pa.int32()), "n": pa.array(columns[2], pa.int64()),
            **{k: pa.array([np.ravel(v) for v in c], numbers) for k, c in zip(("mean_i", "mean_j", "cp"), columns[3:6])}}
    return pa.RecordBatch.from_pydict({**data, "_salt": pa.array(columns[6], pa.int32())} if salted else data)


def _partial(strip: list[tuple[int, int]], width: int, block: int):
    """The tiles of one strip over the rows of a task."""
    spans = {b: slice(b * block, min((b + 1) * block, width)) for t in strip for b in t}

    def run(batches):
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
        n, mean, held = 0, np.zeros(width), {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if not len(x):
                continue
            here = x.mean(axis=0)
            z, gap, both = x - here, here - mean, n + len(x)
            for i, j in strip:
                a, b = spans[i], spans[j]
                more = z[:, a].T @ z[:, b]
                if n:
                    more += np.outer(gap[a], gap[b]) * (n * len(x) / both)
                held[i, j] = held[i, j] + more if (i, j) in held else more
            mean, n = mean + gap * (len(x) / both), both
        for (i, j), cp in held.items():
            yield _batch([(i, j, n, mean[spans[i]], mean[spans[j]], cp, salt)], True)

    return run


def _merged(salted: bool):
    """Neighbouring rows of one tile become one row; only that tile is held."""
    def run(batches):
        key = total = None
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in (("bi", "bj", "_salt") if salted else ("bi", "bj"))]))
            means_i, means_j, cps = (batch.column(c) for c in ("mean_i", "mean_j", "cp"))
            for r, n in enumerate(batch.column("n").to_pylist()):
                part = (n, *(c[r].values.to_numpy() for c in (means_i, means_j, cps)))
                if names[r] != key:
                    if key is not None:
                        yield _batch([(key[0], key[1], *total, key[-1])], salted)
                    key, total = names[r], part
                    continue
                both, gap_i, gap_j = total[0] + n, part[1] - total[1], part[2] - total[2]
                cp = total[3] + part[3] + np.outer(gap_i, gap_j).ravel() * (total[0] * n / both)
                total = (both, total[1] + gap_i * (n / both), total[2] + gap_j * (n / both), cp)
        if key is not None:
            yield _batch([(key[0], key[1], *total, key[-1])], salted)

    return run


def deviations(tiles: DataFrame) -> DataFrame:
    """``(b, n, mean, sd)`` of each block of columns, population scale."""
    own = F.transform(F.sequence(F.lit(0), F.size("mean_i") - 1), lambda k: F.sqrt(F.greatest(F.element_at("cp", k * F.size("mean_i") + k + 1), F.lit(0.0)) / F.col("n")))
    return tiles.where("bi = bj").select(F.col("bi").alias("b"), "n", F.col("mean_i").alias("mean"), own.alias("sd"))


def cells(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows ``(i, j, n, cp, corr)`` for columns ``i <= j``, numbered from 0. A column without spread correlates with
    none: ``corr`` is NULL."""
    sd = deviations(tiles)
    both = (tiles.join(sd.select(F.col("b").alias("bi"), F.col("sd").alias("sd_i")), "bi")
            .join(sd.select(F.col("b").alias("bj"), F.col("sd").alias("sd_j")), "bj"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                bi, bj, n = (batch.column(c)[r].as_py() for c in ("bi", "bj", "n"))
                sd_i, sd_j, cp = (batch.column(c)[r].values.to_numpy() for c in ("sd_i", "sd_j", "cp"))
                i, j = np.divmod(np.arange(len(cp)), len(sd_j))
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = cp / n / (sd_i[i] * sd_j[j])
                kept = bi * block + i <= bj * block + j
                i, j, cp, corr = i[kept] + bi * block, j[kept] + bj * block, cp[kept], corr[kept]
                yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(np.full(len(i), n)), "cp": pa.array(cp),
                                                  "corr": pa.array(corr, mask=~np.isfinite(corr))})

    return both.select("bi", "bj", "n", "sd_i", "sd_j", "cp").mapInArrow(run, "i int, j int, n bigint, cp double, corr double")


def times(tiles: DataFrame, v: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The whole matrix times the p x k matrix ``v``. Tasks multiply their tiles; the products are added by block."""
    k = v.shape[1]

    def multiply(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                bi, bj = batch.column("bi")[r].as_py(), batch.column("bj")[r].as_py()
                left, right = v[bi * block:(bi + 1) * block], v[bj * block:(bj + 1) * block]
                cp = batch.column("cp")[r].values.to_numpy().reshape(len(left), len(right))
                held[bi] = held.get(bi, 0) + cp @ right
                if bi != bj:
                    held[bj] = held.get(bj, 0) + cp.T @ left
        yield from send(held)

    def send(held):
        for b, part in held.items():
            yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "x": pa.array([part.ravel()], pa.list_(pa.float64()))})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column("b")[r].as_py()
                held[b] = held.get(b, 0) + batch.column("x")[r].values.to_numpy()
        yield from send(held)

    kind = "b int, x array<double>"
    parts = tiles.select("bi", "bj", "cp").mapInArrow(multiply, kind).repartition("b").mapInArrow(add, kind)
    out = np.zeros(v.shape)
    for b, x in parts.collect():  # p x k numbers in all
        out[b * block:(b + 1) * block] = np.reshape(x, (-1, k))
    return out


@dataclass
class Components:
    """Principal components: column means, one unit vector per column of ``axes``, their variances, and the variance of all columns."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def share(self) -> np.ndarray:
        return self.variance / self.total if self.total > 0 else np.zeros(len(self.variance))

    def keep(self, share: float) -> "Components":
        """The fewest components that hold ``share`` of the variance, all of them if they hold less."""
        k = int(np.searchsorted(np.cumsum(self.share), share) + 1)
        return Components(self.n, self.mean, self.axes[:, :k], self.variance[:k], self.total)

    def project(self, df: DataFrame, cols: list[str] | str, name: str = "components") -> DataFrame:
        """``df`` with the array column ``name``; NULL where a value is missing. One narrow pass."""
        mean, axes = self.mean, self.axes

        @F.arrow_udf("array<double>")
        def place(x: pa.Array) -> pa.Array:
            known = x.is_valid()
            values = x.filter(known).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            found = iter(((values - mean) @ axes).tolist())
            return pa.array([next(found) if k else None for k in known.to_pylist()], pa.list_(pa.float64()))

        x = F.col(f"`{cols}`").cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
        return df.withColumn(name, place(F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)), x)))


def components(tiles: DataFrame, k: int, block: int = BLOCK, spare: int = 10, rounds: int = 200, tolerance: float = 1e-12, seed: int = 7) -> Components:
    """The ``k`` directions of most variance, by subspace iteration on the tiles.

    Each round multiplies the tiles with ``k + spare`` vectors and turns these to the axes of their span, until the
    variances stand still. If that is all columns, one round gives the whole solution. Signs: the largest entry of
    an axis is positive.
    """
    blocks = deviations(tiles).orderBy("b").collect()  # two numbers per column
    if not blocks:
        raise ValueError("no complete row")
    n, mean = blocks[0].n, np.concatenate([b["mean"] for b in blocks])
    total = float(sum(np.square(b.sd).sum() for b in blocks)) * n
    p = len(mean)
    size = min(p, k + spare)
    q = np.eye(p) if size == p else np.linalg.qr(np.random.default_rng(seed).normal(size=(p, size)))[0]
    before = None
    for _ in range(rounds):
        made = times(tiles, q, block)
        small = q.T @ made
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, axes = values[::-1], q @ turn[:, ::-1]
        if size == p or (before is not None and np.abs(values[:k] - before[:k]).max() <= tolerance * max(abs(values[0]), 1e-300)):
            break
        before, q = values, np.linalg.qr(made @ turn[:, ::-1])[0]
    axes, values = axes[:, :k], np.maximum(values[:k], 0.0)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    # Sample scale, as is usual for components.
    return Components(n, mean, axes, values / max(n - 1, 1), total / max(n - 1, 1))
