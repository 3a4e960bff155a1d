"""Least squares for neighbouring subsets by sweeps, and cross-products for every subset by superset sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelspark.operators.gram import Fit, Gram, fit

PIVOT = 1e-8  # a column whose share of own variance is less hangs on the others
RESTART = 256  # sweeps after which the matrix is made anew, so that rounding does not add up
HELD_BYTES = 1 << 28  # matrices that one group of a superset sum may hold


def scales(g: Gram, xs) -> np.ndarray:
    """Deviations of columns; a constant one has no scale."""
    xs = list(xs)
    scale = np.sqrt(np.maximum(np.diag(g.cp)[xs], 0.0) / g.n)
    scale[scale <= 1e-14 * np.maximum(np.abs(g.mean[xs]), 1e-300)] = np.inf
    return scale


class Sweeper:
    """A regression of column ``y`` of ``g`` on a set of columns that changes one by one.

    The standardised cross-products are swept on the columns of the set: the block of the set then holds minus its
    inverse, the row of ``y`` the coefficients and its corner the sum of squares left. A column enters or leaves by
    one update of rank one. A column that hangs on those inside is *waiting*; while any is, the fit is made anew from
    ``g`` with its effect shared among the columns, as ``gram.fit`` does.
    """

    def __init__(self, g: Gram, y: int):
        self.g, self.y, self.p = g, y, len(g.mean)
        self.scale = scales(g, range(self.p))
        self.y_scale = np.sqrt(g.cp[y, y] / g.n) if g.cp[y, y] > 0 else 1.0
        units = self.scale.copy()
        units[y] = self.y_scale
        self.start = g.cp / np.outer(units, units) / g.n
        self.a, self.inside, self.waiting, self.done = self.start.copy(), set(), set(), 0

    def _sweep(self, k: int, sign: float) -> None:
        column = self.a[:, k].copy()
        d = column[k]
        row = column / d
        self.a -= np.outer(column, row)
        self.a[k, :] = self.a[:, k] = sign * row
        self.a[k, k] = -1.0 / d
        self.done += 1

    def move(self, wanted: set[int]) -> None:
        """Make ``wanted`` the set of columns."""
        if self.done > RESTART:
            self.a, self.inside, self.done = self.start.copy(), set(), 0
        for k in sorted(self.inside - wanted):
            self._sweep(k, -1.0)
        self.inside &= wanted
        self.waiting = set()
        for k in sorted(wanted - self.inside):
            if self.a[k, k] > PIVOT:
                self._sweep(k, 1.0)
                self.inside.add(k)
            else:
                self.waiting.add(k)

    def model(self, constant: bool = True) -> Fit:
        """The fit on the present set; with a constant or, where that was dropped, without."""
        g, y = self.g, self.y
        xs = sorted(self.inside | self.waiting)
        if self.waiting:
            return fit(g, xs, y, constant)
        level = 0.0 if constant else g.n * g.mean[y] ** 2
        beta, inverse = self.a[xs, y] * self.y_scale, -self.a[np.ix_(xs, xs)] / g.n
        ssr = max(self.a[y, y], 0.0) * self.y_scale ** 2 * g.n + level
        total, df_resid = g.cp[y, y] + level, g.n - len(xs) - int(constant)
        sigma2 = ssr / df_resid if df_resid > 0 else np.nan
        coef = np.concatenate([[g.mean[y]] if constant else [], beta])
        se = np.sqrt(sigma2 * np.concatenate([[1.0 / g.n] if constant else [], np.maximum(np.diag(inverse), 0.0)]))
        r2 = 1.0 - ssr / total if total > 0 else np.nan
        r2_adj = 1.0 - (g.n - int(constant)) / df_resid * (1.0 - r2) if df_resid > 0 else np.nan
        return Fit(xs, constant, coef, se, df_resid, ssr, r2, r2_adj, inverse, self.scale[xs])

    def eliminate(self, limit: float = 0.05, rounds: int = 5) -> Fit | None:
        """Drop every term with a p-value over ``limit`` and fit again, ``rounds`` times, the constant like the others.

        The columns that go are swept out of a copy, so that the set stays as it is. None when no term is left."""
        held = self.a, self.inside, self.waiting, self.done
        self.a, self.inside = self.a.copy(), set(self.inside)
        model = self.model()
        try:
            for _ in range(rounds):
                keep = model.p <= limit
                constant = bool(model.constant and keep[0])
                rest = [x for x, k in zip(model.order, keep[1:] if model.constant else keep) if k]
                if not rest and not constant:
                    return None
                if constant == model.constant and len(rest) == len(model.order):
                    return model
                self.done = 0  # no restart on the copy
                self.move(set(rest))
                model = self.model(constant)
            return model
        finally:
            self.a, self.inside, self.waiting, self.done = held


def gray(i: int) -> int:
    """The i-th set of a Gray code: neighbours differ by one member, and 1 to 2^k - 1 gives every set once."""
    return i ^ i >> 1


def zeta(parts: dict[int, Gram], bits: int) -> dict[int, Gram]:
    """For every set of ``bits`` members the sum of the parts of its subsets; sets without any part are left out."""
    out = dict(parts)
    for b in range(bits):
        for c in range(1 << bits):
            if c >> b & 1 and (low := out.get(c ^ 1 << b)) is not None:
                out[c] = low + out[c] if c in out else low
    return out


def superset_sums(parts: DataFrame, part: str, bits: int, m: int, solve, schema: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """For every set of ``bits`` members, add up the packed Grams ``(_set, part, n, mean, cp)`` of all its subsets, and
    give ``solve(set, {part: Gram})`` per set, a dict of the columns of ``schema``.

    The sum over subsets works bit by bit. A group of rows that agree in all other bits does several bits at once in
    one task; as many as ``held_bytes`` allow, so that a step is one shuffle and no task holds more matrices than
    that. The last step solves instead of sending. Sets without any row are not given.
    """
    per = max(1, min(-(-bits // 2), int(np.log2(max(2, held_bytes // (2 * 8 * m * m))))))
    summed = f"_set bigint, {part} string, n bigint, mean array<double>, cp array<double>"
    spans = [(lo, min(lo + per, bits)) for lo in range(0, bits, per)]

    def step(lo: int, hi: int, last: bool):
        kind = to_arrow_schema(StructType.fromDDL(schema if last else summed))

        def run(batches):
            key, held = None, {}
            for batch in batches:
                sets, rests = batch.column("_set").to_pylist(), batch.column("_rest").to_pylist()
                names, counts = batch.column(part).to_pylist(), batch.column("n").to_pylist()
                for r, rest in enumerate(rests):
                    if rest != key:
                        yield from give(key, held)
                        key, held = rest, {}
                    g = Gram.unpack(counts[r], batch.column("mean")[r].values.to_numpy(), batch.column("cp")[r].values.to_numpy())
                    own = held.setdefault(names[r], {})
                    at = sets[r] >> lo & (1 << hi - lo) - 1
                    own[at] = own[at] + g if at in own else g
            yield from give(key, held)

        def give(rest, held):
            if rest is None:
                return
            sums = {name: zeta(own, hi - lo) for name, own in held.items()}
            rows = []
            for at in range(1 << hi - lo):
                found = {name: own[at] for name, own in sums.items() if at in own}
                whole = rest | at << lo
                if last and found:
                    rows.append(solve(whole, found))
                elif not last:
                    rows += [{"_set": whole, part: name, "n": g.n, "mean": g.mean, "cp": g.packed_cp()} for name, g in found.items()]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[at:at + 256], kind)

        return run

    made = parts.select("_set", part, "n", "mean", "cp")
    for lo, hi in spans:
        last = hi == bits
        inner = (1 << hi) - (1 << lo)
        keyed = made.selectExpr("*", f"_set - (_set & {inner}L) AS _rest")
        # Left to itself the adaptive planner would solve the few rows of a small search in one task.
        width = (parts.sparkSession.sparkContext.defaultParallelism,) if last else ()
        made = keyed.repartition(*width, "_rest").sortWithinPartitions("_rest").mapInArrow(step(lo, hi, last), schema if last else summed)
    return made
