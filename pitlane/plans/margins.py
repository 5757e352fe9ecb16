"""Solvers of the margin classifiers (ML08, ML09, ML11): all fits of a kernel share their passes over the rows.

fit_newton: linear machines in the primal. Every pass is one aggregate that gives loss, gradient and Hessian of all fits
(the one of all rows and those that each leave a fold out); the hinge is smoothed, ever more narrowly.

fit_cascade: kernel machines in the dual. Groups of bounded size are solved in tasks, only their support vectors go on,
groups merge in pairs until one is left; then all rows are held against the result and those that violate its margins join
in, until none does: the solution of all rows.

fit_large: both, for any number of rows. Pivots are rows whose kernel functions span those of all rows to a residual of SPANNED
(pivoted Cholesky, Fine & Scheinberg, 2001; every row is checked), so that a kernel machine is a linear one on as many
features as there are pivots. Newton's passes read the rows near the margin or inside it; all rows are held against the result
and those that it would need join in, until none does. The cost is linear in the rows.
"""

from __future__ import annotations

import pickle
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.operators.dims import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Widths of the smoothed hinge, one after the other (the first takes in every row at zero weights), and passes of each at most.
WIDTHS, PASSES = (4.0, 1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001), 30
#: Parts of a Newton step that one pass tries at once; if none helps, the next tries shorter ones.
LENGTHS, SHORTER = (1.0, 0.5, 0.2, 0.06), 0.02
#: Relative decrease of the loss below which the last width is done, and those before it, which only lead there.
SMALL, ROUGH = 1e-8, 1e-4
#: Rows of a cascade's first groups; tolerance of the dual's optimality; rounds of rows that violate the margins.
GROUP_ROWS, DUAL_TOLERANCE, ROUNDS = 2000, 1e-3, 20
#: Kernel columns that a solver holds (a column has a number a row).
COLUMNS = 1500
#: Residual of the kernel's diagonal at which the pivots span a row, and the one to which they are looked for in rows at hand.
SPANNED, SOUGHT = 1e-6, 3e-7
#: Rows of a task that looks for pivots or a first guess of the weights; rows near the margin up to which one task makes all
#: passes; rows that are taken through the kernel at a time.
START_ROWS, LOCAL_ROWS, BLOCK = 1 << 14, 1 << 15, 512
#: Rows up to which the machines are fitted by fit_newton and fit_cascade.
DENSE_ROWS = 15_000
#: Rows whose margin is below 1 + SLACK are read by Newton's passes; widths of the smoothed hinge from the first guess on, which is
#: near, and after no more than a share of FEW has joined in; relative decrease of the loss below which such a fit is done.
SLACK, NEAR_WIDTHS, LAST_WIDTHS, FEW, SMALL_LARGE = 0.5, WIDTHS[2:], WIDTHS[5:], 0.01, 1e-5


# -- primal -----------------------------------------------------------------------------------------------------------

@dataclass
class Primal:
    """One fit: weights with the intercept last, their loss, and the step from there."""

    beta: np.ndarray
    loss: float = float("inf")
    step: np.ndarray | None = None
    scale: float = 1.0
    done: bool = False

    def tries(self) -> list[np.ndarray]:
        if self.step is None:
            return [self.beta]
        return [self.beta + self.scale * t * self.step for t in LENGTHS]


def smooth_pass(rows: DataFrame, asked: list[tuple[int, np.ndarray]], width: float, c: float, d: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, Hessian) at each asked (fit, weights) over rows (x, y, weight, fold); fit -1 takes all rows, others
    leave their fold out."""
    names, at = [f for f, _ in asked], np.array([b for _, b in asked])
    upper = np.triu_indices(d + 1)

    def run(batches):
        loss, grad, hess = np.zeros(len(names)), np.zeros((len(names), d + 1)), np.zeros((len(names), d + 1, d + 1))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            y, s, fold = (batch.column(n).to_numpy() for n in ("y", "weight", "fold"))
            for i, name in enumerate(names):
                short = 1 - y * (x @ at[i])
                on = np.where(fold == name, 0.0, s)
                loss[i] += (on * np.where(short <= 0, 0, np.where(short < width, short * short / (2 * width), short - width / 2))).sum()
                grad[i] -= x.T @ (on * y * np.clip(short / width, 0, 1))
                curved = (short > 0) & (short < width) & (on > 0)
                hess[i] += (x[curved] * (on[curved] / width)[:, None]).T @ x[curved]
        values = np.concatenate([loss[:, None], grad, hess[:, upper[0], upper[1]]], 1)
        n = values.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names), dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(names))),
                                          pa.array(values.ravel())], ["ask", "i", "v"])

    total = rows.mapInArrow(run, "ask int, i int, v double").groupBy("ask", "i").agg(F.sum("v").alias("v"))
    sums = np.zeros((len(asked), 1 + d + 1 + len(upper[0])))
    for r in total.collect():  # about d * d / 2 numbers for each asked
        sums[r["ask"], r["i"]] = r["v"]
    out = []
    for beta, v in zip(at, sums):
        w = np.append(beta[:-1], 0.0)  # the intercept is not held small
        hess = np.zeros((d + 1, d + 1))
        hess[upper] = v[d + 2:]
        hess = c * (hess + np.triu(hess, 1).T) + np.diag([1.0] * d + [1e-8])
        out.append((float(c * v[0] + 0.5 * w @ w), c * v[1:d + 2] + w, hess))
    return out


def fit_newton(rows: DataFrame, d: int, folds: list[int], c: float = 1.0) -> dict[int, np.ndarray]:
    """{fit: weights and intercept} that minimise |w|^2 / 2 + c * sum(weight * hinge) for all rows (-1) and without each fold."""
    def ask(asked, width):
        return [(loss, -np.linalg.solve(hess, grad)) for loss, grad, hess in smooth_pass(rows, [(f, beta) for f, beta, _ in asked], width, c, d)]

    return newton({f: np.zeros(d + 1) for f in [-1, *folds]}, ask, WIDTHS)


def newton(start: dict[int, np.ndarray], ask, widths: tuple, all_curved: bool = True, small: float = SMALL) -> dict[int, np.ndarray]:
    """{fit: weights} from a start, width by width. ask([(fit, weights, curved)], width) gives loss and Newton's step from each; the
    step may be None where curved is false, which all_curved avoids: then a try that is not the longest takes a further pass for it."""
    fits = {f: Primal(beta) for f, beta in start.items()}
    for width in widths:
        for fit in fits.values():
            fit.loss, fit.step, fit.scale, fit.done = float("inf"), None, 1.0, False
        for _ in range(PASSES):
            asked = [(f, beta, all_curved or i == 0) for f, fit in fits.items() if not fit.done for i, beta in enumerate(fit.tries())]
            if not asked:
                break
            got = ask(asked, width)
            for f, fit in fits.items():
                mine = [(*g, beta) for g, (name, beta, _) in zip(got, asked) if name == f]
                if not mine:
                    continue
                loss, step, beta = min(mine, key=lambda m: m[0])
                if fit.step is not None and loss >= fit.loss:  # all too far
                    fit.scale, fit.done = fit.scale * SHORTER, fit.scale < 1e-6
                    continue
                if fit.step is not None or not np.isfinite(fit.loss):  # not asked again for the step only
                    fit.done = fit.loss - loss <= (small if width == WIDTHS[-1] else ROUGH) * max(1.0, abs(loss))
                fit.beta, fit.loss, fit.step, fit.scale = beta, loss, step, 1.0
    return {f: fit.beta for f, fit in fits.items()}


# -- primal, with a kernel ------------------------------------------------------------------------------------------------

@dataclass
class Span:
    """Kernel functions of pivots as features: z(x) = inverse @ k(pivots, x), whose products are the kernel's values. Without a
    kernel (gamma None) the features are the row itself."""

    pivots: np.ndarray | None
    inverse: np.ndarray
    gamma: float | None

    def kernel(self):
        """Function of rows that gives their kernel values with the pivots: exponents are one product."""
        if self.gamma is None:
            return lambda x: x
        g, p = self.gamma, self.pivots
        right = np.concatenate([2 * g * p, np.full((len(p), 1), -g), -g * (p * p).sum(1)[:, None]], 1).T.copy()

        def values(x: np.ndarray) -> np.ndarray:
            k = np.concatenate([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))], 1) @ right
            np.minimum(k, 0, out=k)
            return np.exp(k, out=k)

        return values

    def residuals(self, x: np.ndarray) -> np.ndarray:
        """What the pivots leave of each row's kernel function (squared length, 1 at most)."""
        out, values, to = np.ones(len(x)), self.kernel(), self.inverse.T.copy()
        for a in range(0, len(x), BLOCK):
            z = values(x[a:a + BLOCK]) @ to
            out[a:a + BLOCK] -= np.einsum("ij,ij->i", z, z)
        return out

    def machine(self, beta: np.ndarray) -> SupportVectors | np.ndarray:
        return beta if self.gamma is None else SupportVectors(self.pivots, self.inverse.T @ beta[:-1], float(beta[-1]), self.gamma)


def inverted(pivots: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """The pivots and the inverse of their kernel's Cholesky factor."""
    return pivots, np.linalg.solve(np.linalg.cholesky(rbf(pivots, pivots, gamma)), np.eye(len(pivots)))


def pivots_of(x: np.ndarray, gamma: float, first: int = 0) -> np.ndarray:
    """Rows of x whose kernel functions span those of all rows of x to SOUGHT: the first ones as given, then always the row that is
    spanned worst."""
    left, lower, found = np.ones(len(x)), np.zeros((64, len(x))), []
    while len(found) < len(x):
        i = len(found) if len(found) < first else int(left.argmax())
        if left[i] <= SOUGHT and len(found) >= first:
            break
        k = len(found)
        if k == len(lower):
            lower = np.concatenate([lower, np.zeros_like(lower)])
        lower[k] = (rbf(x, x[i:i + 1], gamma)[:, 0] - lower[:k, i] @ lower[:k]) / np.sqrt(left[i])
        left = np.maximum(left - lower[k] ** 2, 0)
        left[i] = 0
        found.append(i)
    return x[found]


def in_task(rows: DataFrame, do):
    """do([(x, y, weight, fold)]) of rows that one task holds. Linear algebra in tasks has one thread; on the driver, whose process starts
    others, the threads of a library may wait for each other for ever."""
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(do([columns(b) for b in batches if len(b)]))], pa.binary())], ["v"])

    return pickle.loads(rows.coalesce(1).mapInArrow(run, "v binary").first()["v"])


def span_rows(rows: DataFrame, some: DataFrame, gamma: float) -> Span:
    """Pivots that span every row. Those of some rows come first; all rows are held against them once, and those that they
    leave out again and again until none is: what pivots span, more pivots span too."""
    span = Span(*in_task(some, lambda parts: inverted(pivots_of(np.concatenate([x for x, *_ in parts]), gamma), gamma)), gamma)
    left = rows
    while True:
        own = span

        def run(batches):
            for batch in batches:
                x = columns(batch)[0]
                bad = own.residuals(x)
                at = bad > SPANNED
                yield batch.filter(pa.array(at)).append_column("residual", pa.array(bad[at]))

        left = materialize(left.select(*ROW).mapInArrow(run, f"{ROWS}, residual double"))
        if left.isEmpty():
            return span
        worst = left.orderBy(F.desc("residual")).limit(START_ROWS // 4)
        span = Span(*in_task(worst, lambda parts: inverted(pivots_of(np.concatenate([own.pivots, *(x for x, *_ in parts)]), gamma, len(own.pivots)), gamma)), gamma)


def spanned_sums(batches, asked: list[tuple[int, np.ndarray, bool]], width: float, span: Span) -> tuple[np.ndarray, dict]:
    """(loss and gradient by the kernel's values of each asked, {asked: Hessian by the features} of the curved) over batches
    (x, y, weight, fold)."""
    values, to, r = span.kernel(), span.inverse.T.copy(), len(span.inverse)
    at = np.array([np.append(to @ beta[:-1], beta[-1]) for _, beta, _ in asked]).T
    names = np.array([f for f, _, _ in asked])
    bent = [i for i, (_, _, curved) in enumerate(asked) if curved]
    sums, hess = np.zeros((len(asked), r + 2)), {i: np.zeros((r + 1, r + 1)) for i in bent}
    held, n_held = [], 0

    def fold_in():
        z = np.concatenate([k for k, _ in held]) @ to
        z = np.concatenate([z, np.ones((len(z), 1))], 1)
        for i, by in zip(bent, np.concatenate([b for _, b in held]).T):
            on = by > 0
            hess[i] += (z[on] * by[on][:, None]).T @ z[on]

    for x, y, s, fold in batches:
        for a in range(0, len(x), BLOCK):
            b = slice(a, a + BLOCK)
            k, sign = values(x[b]), y[b][:, None]
            short = 1 - sign * (k @ at[:-1] + at[-1])
            on = np.where(fold[b][:, None] == names, 0.0, s[b][:, None])
            sums[:, 0] += (on * np.where(short <= 0, 0, np.where(short < width, short * short / (2 * width), short - width / 2))).sum(0)
            slope = on * sign * np.clip(short / width, 0, 1)
            sums[:, 1:-1] -= slope.T @ k
            sums[:, -1] -= slope.sum(0)
            curve = np.where((short > 0) & (short < width), on / width, 0.0)[:, bent]
            rows = np.flatnonzero(curve.any(1))
            if len(rows):
                held.append((k[rows], curve[rows]))
                n_held += len(rows)
            if n_held >= 4 * BLOCK:
                fold_in()
                held, n_held = [], 0
    if held:
        fold_in()
    return sums, hess


def from_sums(asked: list, sums: np.ndarray, hess: dict, span: Span, c: float) -> list[tuple[float, np.ndarray | None]]:
    """(loss, Newton's step or None) of each asked, from the sums of spanned_sums."""
    out, r = [], len(span.inverse)
    for i, (_, beta, _) in enumerate(asked):
        w = np.append(beta[:-1], 0.0)  # the intercept is not held small
        grad = c * np.append(span.inverse @ sums[i, 1:-1], sums[i, -1]) + w
        step = -np.linalg.solve(c * hess[i] + np.diag([1.0] * r + [1e-8]), grad) if i in hess else None
        out.append((float(c * sums[i, 0] + 0.5 * w @ w), step))
    return out


def spanned_pass(rows: DataFrame, asked: list, width: float, c: float, span: Span) -> list[tuple[float, np.ndarray | None]]:
    """newton()'s answers over all rows: every task sums its own, equal lines of the matrices are then summed together, and those of
    a fit are solved in a task."""
    r, kind = len(span.inverse), "ask int, i int, v binary"

    def batch_of(lines: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*lines), (pa.int32(), pa.int32(), pa.binary()))], ["ask", "i", "v"])

    def run(batches):
        sums, hess = spanned_sums(map(columns, batches), asked, width, span)
        yield batch_of([(i, -1, v.tobytes()) for i, v in enumerate(sums)] + [(i, j, v.tobytes()) for i, h in hess.items() for j, v in enumerate(h)])

    def totals(batches) -> dict:
        total: dict = {}
        for batch in batches:
            for ask, i, v in zip(*(batch.column(n).to_pylist() for n in ("ask", "i", "v"))):
                total[ask, i] = total.get((ask, i), 0) + np.frombuffer(v)
        return total

    def add(batches):
        total = totals(batches)
        if total:
            yield batch_of([(ask, i, v.tobytes()) for (ask, i), v in total.items()])

    def solve(batches):
        total = totals(batches)
        for ask in sorted({ask for ask, _ in total}):
            hess = {0: np.array([total[ask, j] for j in range(r + 1)])} if (ask, 0) in total else {}
            loss, step = from_sums([asked[ask]], total[ask, -1][None], hess, span, c)[0]
            yield batch_of([(ask, int(step is not None), np.append(loss, [] if step is None else step).tobytes())])

    out = rows.mapInArrow(run, kind).repartition("ask", "i").mapInArrow(add, kind).repartition("ask").mapInArrow(solve, kind)
    found = {line["ask"]: (line["i"], np.frombuffer(line["v"])) for line in out.collect()}  # one row an asked
    return [(float(v[0]), v[1:] if has else None) for has, v in (found[i] for i in range(len(asked)))]


ROW, ROWS = ("x", "y", "weight", "fold"), "x array<double>, y double, weight double, fold int"


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    return x, *(batch.column(n).to_numpy() for n in ("y", "weight", "fold"))


def near_rows(rows: DataFrame, span: Span, seen: list[list[np.ndarray]], new: list[np.ndarray]) -> DataFrame:
    """Rows whose margin is below 1 + SLACK for any of the new weights, and was not for any of those seen; short: whether it is
    below 1, so that the loss of the new weights counts them."""
    to = span.inverse.T
    at = [np.array([np.append(to @ beta[:-1], beta[-1]) for beta in betas]).T for betas in [new, *seen]]

    def run(batches):
        values = span.kernel()
        for batch in batches:
            x, y, *_ = columns(batch)
            keep, short = np.zeros(len(x), bool), np.zeros(len(x), bool)
            for a in range(0, len(x), BLOCK):
                b = slice(a, a + BLOCK)
                k = values(x[b])
                least = [(y[b][:, None] * (k @ w[:-1] + w[-1])).min(1) for w in at]
                keep[b] = (least[0] < 1 + SLACK) & np.all([m >= 1 + SLACK for m in [np.full(len(k), np.inf), *least[1:]]], axis=0)
                short[b] = keep[b] & (least[0] < 1)
            yield batch.filter(pa.array(keep)).append_column("short", pa.array(short[keep]))

    return materialize(rows.select(*ROW).mapInArrow(run, f"{ROWS}, short boolean"))


def fit_large(rows: DataFrame, folds: list[int], gamma: float | None, c: float = 1.0) -> dict[int, SupportVectors | np.ndarray]:
    """{fit: machine} over rows (x, y, weight, fold), of any number: all rows (-1) and without each fold; with the kernel, or without
    (gamma None) as weights with the intercept last. A fit on some rows is the first guess only: the result is that of all rows,
    as those that no pass has read have a margin of 1 or more under it."""
    n, d = rows.count(), len(rows.first()["x"])
    share = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < max(1, int(START_ROWS / n * (1 << 30)))
    some = rows.where(share).limit(2 * START_ROWS)
    some = materialize(rows.limit(START_ROWS) if some.isEmpty() else some)
    span = Span(None, np.eye(d), None) if gamma is None else span_rows(rows, some, gamma)

    def guess(parts):
        scale = c * n / sum(len(y) for _, y, *_ in parts)
        return newton({-1: np.zeros(len(span.inverse) + 1)}, lambda asked, width: from_sums(asked, *spanned_sums(parts, asked, width, span), span, scale), WIDTHS[:4], False)

    first = in_task(some, guess)[-1]
    fitted, seen, widths = {f: first for f in [-1, *folds]}, [], NEAR_WIDTHS
    near = near_rows(rows, span, seen, [first])
    while True:
        seen.append(list(fitted.values()))
        begin, by = fitted, widths
        if near.count() <= LOCAL_ROWS:
            fitted = in_task(near, lambda parts: newton(begin, lambda asked, width: from_sums(asked, *spanned_sums(parts, asked, width, span), span, c), by, False, SMALL_LARGE))
        else:
            fitted = newton(begin, lambda asked, width: spanned_pass(near, asked, width, c, span), widths, False, SMALL_LARGE)
        more = near_rows(rows, span, seen, list(fitted.values()))
        short = more.where("short").count()
        if not short:
            machines = {f: span.machine(beta) for f, beta in fitted.items()}
            if gamma is not None:
                machines[-1].n_rows = near_rows(near, span, [], [fitted[-1]]).where("short").count()
            return machines
        widths = LAST_WIDTHS if short <= FEW * near.count() else NEAR_WIDTHS
        near = materialize(near.unionByName(more))


# -- dual -------------------------------------------------------------------------------------------------------------

@dataclass
class SupportVectors:
    """A kernel machine as a table: vectors (rows or pivots), coefficients (alpha * y for rows), intercept; n_rows: how many rows
    of the fit lie inside the margin, where the vectors are pivots."""

    x: np.ndarray
    coef: np.ndarray
    bias: float
    gamma: float
    n_rows: int | None = None

    def support_rows(self) -> int:
        return len(self.coef) if self.n_rows is None else self.n_rows

    def margins(self, z: np.ndarray, block: int = 256) -> np.ndarray:
        """Rows meet the vectors in squares of block, which stay in the processor's cache; the exponents of a square are one
        product, as -g|a - b|^2 = (a, |a|^2, 1) (2 g b, -g, -g|b|^2)."""
        g, x = self.gamma, self.x
        out = np.full(len(z), self.bias)
        left = np.concatenate([z, (z * z).sum(1)[:, None], np.ones((len(z), 1))], 1)
        right = np.concatenate([2 * g * x, np.full((len(x), 1), -g), -g * (x * x).sum(1)[:, None]], 1).T.copy()
        for a in range(0, len(z), block):
            for b in range(0, len(x), block):
                k = left[a:a + block] @ right[:, b:b + block]
                np.minimum(k, 0, out=k)
                np.exp(k, out=k)
                out[a:a + block] += k @ self.coef[b:b + block]
        return out

    def column(self, features: Column) -> Column:
        """The margin of rows whose features are an array of doubles; rows meet the vectors in blocks."""
        x, coef, bias, gamma = self.x, self.coef, self.bias, self.gamma

        @F.pandas_udf(T.DoubleType())
        def margin(batch: pd.Series) -> pd.Series:
            known = batch.notna().to_numpy()
            out = np.full(len(batch), np.nan)
            if known.any():
                z = np.array(batch[known].tolist(), np.float64)
                out[known] = SupportVectors(x, coef, bias, gamma).margins(z)
            return pd.Series(out, dtype="float64").where(~np.isnan(out), None)

        return margin(features)

    def to_dict(self) -> dict:
        return {"x": self.x.tolist(), "coef": self.coef.tolist(), "bias": self.bias, "gamma": self.gamma}

    @classmethod
    def from_dict(cls, d: dict) -> SupportVectors:
        return cls(np.array(d["x"]), np.array(d["coef"]), d["bias"], d["gamma"])


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    dist = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(dist, 0))


def solve_dual(x: np.ndarray, y: np.ndarray, cap: np.ndarray, gamma: float, alpha: np.ndarray, tolerance: float = DUAL_TOLERANCE) -> tuple[np.ndarray, float]:
    """(alpha, bias) of the box-constrained dual by steps on the pair that violates optimality most, from a feasible alpha."""
    alpha, held = alpha.copy(), {}

    def column(i: int) -> np.ndarray:
        if i not in held:
            if len(held) >= COLUMNS:
                held.pop(next(iter(held)))
            held[i] = rbf(x, x[i:i + 1], gamma)[:, 0]
        return held[i]

    short = y.astype(float)  # y - sum(alpha y k): what a row lacks without the intercept
    for part in np.array_split(np.flatnonzero(alpha), max(1, len(x) // 500)):
        if len(part):
            short = short - rbf(x, x[part], gamma) @ (alpha[part] * y[part])
    high, low = np.inf, -np.inf
    for _ in range(100 * len(x) + 10_000):
        up = np.where(y > 0, alpha < cap, alpha > 0)
        down = np.where(y > 0, alpha > 0, alpha < cap)
        if not up.any() or not down.any():
            break
        rise = np.where(up, short, -np.inf)
        i = int(rise.argmax())
        high, low = float(rise[i]), float(np.where(down, short, np.inf).min())
        if high - low < tolerance:
            break
        ki = column(i)
        gap = np.where(down & (short < high), high - short, 0.0)
        bend = np.maximum(2 - 2 * ki, 1e-12)
        j = int((gap * gap / bend).argmax())
        t = min(gap[j] / bend[j], cap[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cap[j] - alpha[j])
        alpha[i] += y[i] * t
        alpha[j] -= y[j] * t
        for k in (i, j):  # exactly on the box's sides
            alpha[k] = 0.0 if alpha[k] < 1e-12 * cap[k] else cap[k] if alpha[k] > cap[k] * (1 - 1e-12) else alpha[k]
        short = short - t * (ki - column(j))
    return alpha, (high + low) / 2 if np.isfinite(high + low) else 0.0


SOLVED = "fit int, part int, x array<double>, y double, weight double, key long, alpha double, bias double"


def solve_groups(rows: DataFrame, c: float, gamma: float) -> DataFrame:
    """Every group (fit, part) solved in a task, from its rows' alphas: the support vectors with theirs."""
    def run(table):
        x = np.array(table.column("x").to_pylist())
        y, weight, alpha = (table.column(n).to_numpy() for n in ("y", "weight", "alpha"))
        alpha, bias = solve_dual(x, y, c * weight, gamma, alpha)
        keep = np.flatnonzero(alpha > 0)
        if not len(keep):  # one class only: a row stands for it, with the bias of its sign
            keep, bias = np.array([0]), float(y[0])
        out = table.take(keep)
        return out.set_column(out.schema.get_field_index("alpha"), "alpha", pa.array(alpha[keep])).set_column(
            out.schema.get_field_index("bias"), "bias", pa.array(np.full(len(keep), bias)))

    return materialize(rows.groupBy("fit", "part").applyInArrow(run, SOLVED))


def machine(rows: list, gamma: float) -> SupportVectors:
    on = [r for r in rows if r["alpha"] > 0]
    d = len(rows[0]["x"])
    return SupportVectors(np.array([r["x"] for r in on]).reshape(-1, d), np.array([r["alpha"] * r["y"] for r in on]), rows[0]["bias"], gamma)


def fit_cascade(rows: DataFrame, folds: list[int], gamma: float, c: float = 1.0, n_rows: int | None = None) -> dict[int, SupportVectors]:
    """{fit: machine} over rows (x, y, weight, fold), which are bounded in number (documented cap): all rows (-1) and without
    each fold. Rows of a fit are those whose fold it does not leave out."""
    fits = F.array(*[F.lit(f) for f in [-1, *folds]])
    n = rows.count() if n_rows is None else n_rows
    groups = 1
    while groups * GROUP_ROWS < n:
        groups *= 2
    each = rows.withColumn("key", F.monotonically_increasing_id())
    each = materialize(each.withColumn("fit", F.explode(fits)).where(F.col("fit") != F.col("fold")))
    first = each.select("fit", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("part"), "x", "y", "weight", "key",
                        F.lit(0.0).alias("alpha"), F.lit(0.0).alias("bias"))
    found = solve_groups(first, c, gamma)
    while groups > 1:
        groups //= 2
        found = solve_groups(found.withColumn("part", F.pmod(F.col("part"), F.lit(groups))), c, gamma)
    out: dict[int, SupportVectors] = {}
    open_fits = set([-1, *folds])
    for _ in range(ROUNDS):
        got: dict[int, list] = {}
        for r in found.where(F.col("fit").isin(sorted(open_fits))).collect():  # support vectors of the capped rows
            got.setdefault(r["fit"], []).append(r)
        out |= {f: machine(rs, gamma) for f, rs in got.items()}
        ask = {f: out[f] for f in open_fits if f in out}
        worse = materialize(violators(each, found, ask))
        open_fits = {r["fit"] for r in worse.select("fit").distinct().collect()}
        if not open_fits:
            break
        found = solve_groups(found.where(F.col("fit").isin(sorted(open_fits))).unionByName(worse), c, gamma)
    return out


def violators(each: DataFrame, found: DataFrame, machines: dict[int, SupportVectors]) -> DataFrame:
    """Rows outside the support vectors that lie inside the margin of their fit's machine: they must join in."""
    if not machines:
        return found.limit(0)

    def run(batches):
        for batch in batches:
            fit = batch.column("fit").to_numpy()
            x = np.array(batch.column("x").to_pylist()) if len(batch) else np.zeros((0, 1))
            bad = np.zeros(len(batch), bool)
            for f, m in machines.items():
                at = np.flatnonzero(fit == f)
                if len(at):
                    y = batch.column("y").to_numpy()[at]
                    bad[at] = y * m.margins(x[at]) < 1 - 2 * DUAL_TOLERANCE
            yield batch.filter(pa.array(bad))

    other = each.select("fit", F.lit(0).alias("part"), "x", "y", "weight", "key", F.lit(0.0).alias("alpha"), F.lit(0.0).alias("bias"))
    free = other.join(found.select("fit", "key"), ["fit", "key"], "left_anti").select(*[c.split()[0] for c in SOLVED.split(", ")])
    return free.mapInArrow(run, SOLVED)


# -- calibration ------------------------------------------------------------------------------------------------------

@dataclass
class Platt:
    """Probability of class 1 from a margin: 1 / (1 + exp(-(a * margin + b)))."""

    a: float
    b: float

    def column(self, margin: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(margin * F.lit(self.a) + F.lit(self.b))))


def fit_platt(margins: DataFrame, margin: str = "margin", label: str = "label") -> Platt | None:
    """Logistic regression on the margin with Platt's targets, so that it is finite for separated classes too. Each Newton
    step is one aggregate of five sums; none without rows of both classes."""
    n = margins.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    if not n["pos"] or not n["neg"]:
        return None
    target = F.when(F.col(label) == 1, (n["pos"] + 1) / (n["pos"] + 2)).otherwise(1 / (n["neg"] + 2))
    m, at = F.col(margin), np.array([0.0, float(np.log((n["pos"] + 1) / (n["neg"] + 1)))])
    best, step, size = float("inf"), np.zeros(2), 1.0
    for _ in range(50):
        a, b = (at + size * step).tolist()
        z = m * a + b
        p = 1.0 / (1.0 + F.exp(-z))
        miss, bend = p - target, p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        r = margins.agg(F.sum(loss).alias("l"), F.sum(miss * m).alias("ga"), F.sum(miss).alias("gb"), F.sum(bend * m * m).alias("aa"),
                        F.sum(bend * m).alias("ab"), F.sum(bend).alias("bb")).first()
        if r["l"] > best and size > 1e-6:
            size *= 0.25
            continue
        at, small = at + size * step, best - r["l"] <= 1e-10 * max(1.0, abs(r["l"]))
        best, size = min(best, r["l"]), 1.0
        if small:
            break
        step = -np.linalg.solve(np.array([[r["aa"] + 1e-10, r["ab"]], [r["ab"], r["bb"] + 1e-10]]), np.array([r["ga"], r["gb"]]))
    return Platt(float(at[0]), float(at[1]))
