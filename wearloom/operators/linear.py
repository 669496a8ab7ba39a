"""Linear fits of the vibration baseline: ridge, Huber and consensus, several at once.

The work is in ``bordered``: passes over rows laid out by machine, whose sums serve all fits.
Here are the rounds of each kind of fit, the fitted model and its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.functions import selection
from wearloom.functions.tables import kept
from wearloom.operators.bordered import KEYS, Batch, Problem, Rows, _lines, _numbers, _runs, _states, finite, measure
from wearloom.operators.robust import NORMAL
from wearloom.params import Params

__all__ = ["KEYS", "Linear", "cell_moments", "measure"]
#: Step lengths that a pass of a joint fit looks at, and scales that its first pass does.
LENGTHS, FIRST_SCALES = (1.0, 0.5, 0.2, 0.04), (1.0, 0.3, 0.1, 0.03)
#: Trials of a consensus fit whose samples one pass sums up.
TRIALS_AT_ONCE = 30


@dataclass
class Linear:
    """Intercept, slopes on a measure of power and quantity, per part (shift, slope on it), and a
    table of what each machine adds (machine_id, shifts, slopes), of which ``at`` is this model's
    place. Levels that are not there add nothing."""

    intercept: float
    power: float
    quantity: float
    parts: dict[str, tuple[float, float]] = field(default_factory=dict)
    machines: DataFrame | None = None
    at: int = 0
    rounds: int = 1
    measure: str = "log_net_power_kw"

    def as_dict(self) -> dict:
        """All but the table of machines."""
        return {"intercept": self.intercept, "power": self.power, "quantity": self.quantity, "parts": self.parts, "at": self.at, "rounds": self.rounds, "measure": self.measure}

    def machine_table(self) -> DataFrame:
        """(machine_id, shift, slope)."""
        return self.machines.select("machine_id", F.col("shifts")[self.at].alias("shift"), F.col("slopes")[self.at].alias("slope"))

    def with_prediction(self, df: DataFrame, name: str) -> DataFrame:
        return with_predictions(df, {name: self})


def _part(model: Linear, i: int) -> Column:
    if not model.parts:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, v in model.parts.items() for x in (k, float(v[i]))])
    return F.coalesce(table[F.col("part_type")], F.lit(0.0))


def with_predictions(df: DataFrame, models: dict[str, Linear]) -> DataFrame:
    """df with a column of predictions per model. Machines' tables meet the rows by joins, which
    Spark broadcasts if they are small; models of one batch share a table."""
    q, out = measure("quantity"), df
    tables = {id(m.machines): m.machines for m in models.values()}
    for i, table in enumerate(tables.values()):
        if table is not None:
            out = out.join(table.select(F.col("machine_id").alias(f"_of{i}"), F.col("shifts").alias(f"_shifts{i}"), F.col("slopes").alias(f"_slopes{i}")), F.col("machine_id") == F.col(f"_of{i}"), "left")
    columns = {}
    for name, m in models.items():
        i = list(tables).index(id(m.machines))
        own = lambda kind: F.coalesce(F.col(f"_{kind}{i}")[m.at], F.lit(0.0)) if m.machines is not None else F.lit(0.0)  # noqa: B023, E731
        columns[name] = F.lit(m.intercept) + _part(m, 0) + own("shifts") + (F.lit(m.power) + _part(m, 1) + own("slopes")) * measure(m.measure) + F.lit(m.quantity) * q
    return out.withColumns(columns).drop(*[c for i in range(len(tables)) for c in (f"_of{i}", f"_shifts{i}", f"_slopes{i}")])


def cell_moments(cutting: DataFrame, target: str = "log_vibration_rms_g", weight: Column | None = None) -> DataFrame:
    """(machine_id, part_type, n, sx, sq, sxx, sxq, sqq, sy, sxy, sqy, syy): weighted sums per
    cell, over the rows that have a finite target."""
    w, x, q, y = (F.lit(1.0) if weight is None else weight), measure("log_net_power_kw"), measure("quantity"), finite(target)
    sums = {"n": w, "sx": w * x, "sq": w * q, "sxx": w * x * x, "sxq": w * x * q, "sqq": w * q * q, "sy": w * y, "sxy": w * x * y, "sqy": w * q * y, "syy": w * y * y}
    return cutting.where(y.isNotNull()).groupBy("machine_id", "part_type").agg(*[F.sum(e).alias(k) for k, e in sums.items()])


@dataclass(frozen=True)
class Fit:
    """What is asked for: a model by name (ridge, huber, joint_huber, ransac or joint_ransac) for
    a target and a measure of power, without a fold. The joint forms are those of the backend "joint"."""

    model: str
    target: str = "log_vibration_rms_g"
    power: str = "log_net_power_kw"
    left_out: int | None = None


def asked(name: str, p: Params, **more) -> Fit:
    """The fit of a primary model under the chosen backend."""
    name = "ransac" if name == "robust" else name
    return Fit(f"joint_{name}" if p.backend == "joint" and name != "ridge" else name, **more)


def _problem(f: Fit, p: Params) -> Problem:
    alpha = p.ridge_alpha if f.model == "ridge" else 1e-6 if "ransac" in f.model else 1e-4
    return Problem(f.target, f.power, alpha=alpha, scaled=p.backend != "joint", left_out=f.left_out, epsilon=p.huber_epsilon)


def fit_all(cutting: DataFrame, fits: list[Fit], p: Params = Params(), folds: int = 0, rows: Rows | None = None) -> tuple[list[Linear], Batch]:
    """All fits together, in the order asked for, and the batch that they came of.

    The first pass solves the squares of every fit. Joint Huber fits then take damped second-order
    steps, all of them in each pass, until a step promises nothing; iterated ones select the
    median residual and its MAD before each pass; consensus fits draw their trials from a batch
    of their own and are refitted to the best trial's inliers.
    """
    rows = rows or Rows(cutting, list(dict.fromkeys((f.target, f.power) for f in fits)), folds, p.random_state)
    batch = Batch(rows, [_problem(f, p) for f in fits])
    batch.step(first=True)
    of = lambda *models: [k for k, f in enumerate(fits) if f.model in models and batch.known[k]["n"]]
    moving = of("joint_huber", "huber")
    rest = [k for k in range(len(fits)) if k not in moving]
    batch.settle(*rest)
    for k, point in enumerate(batch.points):
        point.active = k in moving
    _joint_rounds(batch, of("joint_huber"))
    _reweighted_rounds(batch, of("huber"), p)
    if consensus := of("ransac", "joint_ransac"):
        _consensus(batch, consensus, [fits[k] for k in consensus], p)
    table = batch.coefficients()
    return [_model(batch, k, table, fits[k], p) for k in range(len(fits))], batch


def _model(batch: Batch, k: int, table: DataFrame, f: Fit, p: Params) -> Linear:
    theta, parts = batch.points[k].theta, batch.rows.parts
    level = lambda i: (float(theta[2 + i]), float(theta[1 + len(parts) + i]))
    return Linear(float(theta[0]), float(theta[1]), float(theta[2]), {v: level(i) for i, v in enumerate(parts) if i}, table, k, batch.points[k].rounds, f.power)


def _joint_rounds(batch: Batch, joint: list[int], rounds: int = 60) -> None:
    """Coefficients and scale together, from the solution of the squares on. Where most rows are met
    exactly (as many unknowns as rows) the scale falls without end; the rounds' limit stops that."""
    for k in joint:
        point, n = batch.points[k], batch.known[k]["n"]
        spread = float(np.sqrt(max(point.loss - point.drop, 0.0) / n)) + 1e-12  # the promise of a step for squares is kept
        point.kind, point.tried, point.rounds = "joint", [(1.0, spread * s) for s in FIRST_SCALES], 0
    while open_ones := [k for k in joint if batch.points[k].active]:
        batch.step()
        done = []
        for k in open_ones:
            point = batch.points[k]
            if point.drop <= 1e-13 * max(abs(point.loss), 1e-300) or point.rounds >= rounds:
                done.append(k)
                continue
            sigma, by = point.theta[-1], max(point.step[-1], -0.9 * point.theta[-1])
            point.tried = [(t, max(sigma + t * by, 0.05 * sigma)) for t in LENGTHS]
        if done:
            batch.settle(*done)
            for k in done:
                batch.points[k].active = False


def _spread(batch: Batch, k: int, n: int, near=None, width=None) -> tuple[float, float]:
    """Median residual of problem k and the MAD around it, selected in brackets."""
    rows, of = batch.target_rows(k), batch.residuals(k)
    if near is None:
        spread = float(np.sqrt(max(batch.points[k].loss, 0.0) / n)) + 1e-9
        near, width = (-spread, spread), (0.0, 3 * spread)
    centre = selection.narrowed(rows, [0.5], n, [near], of)[0]
    return centre, selection.narrowed(rows, [0.5], n, [width], lambda b: np.abs(of(b) - centre))[0]


def _reweighted_rounds(batch: Batch, ones: list[int], p: Params, tol: float = 1e-8) -> None:
    """Squares with Huber's weights, whose scale is the MAD at the point reached, until it stays."""
    before: dict[int, tuple[float, float]] = {}
    brackets: dict[int, tuple] = {k: (None, None) for k in ones}
    if ones:
        batch.settle(*ones)
    for k in ones:
        batch.points[k].kind, batch.points[k].rounds = "reweighted", 0
    while open_ones := [k for k in ones if batch.points[k].active]:
        for k in open_ones:
            n = int(batch.known[k]["n"])
            centre, mad = _spread(batch, k, n, *brackets[k])
            was = before.get(k, (centre + mad, 2 * mad))
            before[k], brackets[k] = (centre, mad), (selection.around(centre, abs(centre - was[0]), mad, n), selection.around(mad, abs(mad - was[1]), mad, n))
            batch.points[k].limit, batch.points[k].tried = p.huber_epsilon * max(NORMAL * mad, 1e-9), [(1.0, 1.0)]
        batch.step()
        batch.settle(*open_ones)
        for k in open_ones:
            point = batch.points[k]
            point.active = np.sqrt(2 * point.drop / batch.known[k]["n"]) > tol and point.rounds < p.huber_rounds


def _consensus(batch: Batch, ones: list[int], fits: list[Fit], p: Params, share: float = 0.15) -> None:
    """The trial with the most rows within a limit, refitted to these.

    The limit is twice the scaled MAD of the residuals of the plain fit, or, in the joint form,
    the MAD of the target. A row is in a trial's sample by a hash of its keys; a pass sums up
    some trials of all fits, and a second counts their inliers.
    """
    limits, best = {}, {k: (-1, -1) for k in ones}
    for k, f in zip(ones, fits):
        n = int(batch.known[k]["n"])
        if f.model == "ransac":
            limits[k] = max(2 * NORMAL * _spread(batch, k, n)[1], 1e-9)
        else:
            y = batch.target_rows(k)
            middle = selection.median(y, F.col("y"))
            limits[k] = max(selection.median(y, F.abs(F.col("y") - middle)), 1e-9)
    kept_trials: dict[int, tuple[Batch, int]] = {}
    for at in range(0, p.ransac_trials, TRIALS_AT_ONCE):
        pairs = [(k, t) for k in ones for t in range(at, min(at + TRIALS_AT_ONCE, p.ransac_trials))]
        least = lambda k: min(1.0, max(share * batch.known[k]["n"], batch.rows.size, 50) / batch.known[k]["n"])
        own = Batch(batch.rows, [replace(batch.problems[k], trial=t, share=least(k)) for k, t in pairs])
        own.step(first=True)
        own.settle(*range(len(pairs)))
        hits = _within(own, [limits[k] for k, _ in pairs])
        for i, (k, t) in enumerate(pairs):
            if hits[i] > best[k][0]:
                best[k], kept_trials[k] = (hits[i], t), (own, i)
    for k in ones:
        own, i = kept_trials[k]
        batch.points[k].theta, batch.points[k].step = own.points[i].theta.copy(), np.zeros(batch.rows.size)
        batch.points[k].kind, batch.points[k].limit, batch.points[k].tried, batch.points[k].active = "inliers", limits[k], [(1.0, 1.0)], True
    _take_states(batch, {k: kept_trials[k] for k in ones})
    batch.step()
    batch.settle(*ones)
    for k in ones:
        batch.points[k].active, batch.points[k].rounds = False, p.ransac_trials


def _within(batch: Batch, limits: list[float]) -> list[int]:
    """Rows of each problem, sampled or not, whose residual is within its limit."""
    problems, parts, nk = batch.problems, len(batch.rows.parts), len(batch.problems)
    forms, count = [batch.rows.form(p) for p in problems], len(batch.rows.forms)
    lines = [_lines(p.theta, parts) for p in batch.points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(nk, np.int64)
        for some, starts, of in _runs(batches):
            states = _states(some, starts, nk)
            q, part, fold = (_numbers(some, c) for c in ("q", "part", "fold"))
            both = [(_numbers(some, f"x{i}"), _numbers(some, f"y{i}").astype(float)) for i in range(count)]
            for k, p in enumerate(problems):
                line, state = lines[k][part], states[of, k]
                x, y = both[forms[k]]
                r = y - line[:, 0] - state[:, 0] - (line[:, 1] + state[:, 1]) * x - line[:, 2] * q
                inside = np.abs(r) <= limits[k]  # not where the target is missing
                hits[k] += np.count_nonzero(inside if p.left_out is None else inside & (fold != p.left_out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(nk)), pa.array(hits)], ["k", "hits"])

    found = batch.joined().mapInArrow(run, "k long, hits long").groupBy("k").agg(F.sum("hits").alias("hits")).collect()
    out = dict.fromkeys(range(nk), 0) | {r["k"]: r["hits"] for r in found}
    return [out[k] for k in range(nk)]


def _take_states(batch: Batch, taken: dict[int, tuple[Batch, int]]) -> None:
    """batch's machines with the coefficients that the chosen trials' batches have for them; all
    batches have the same machines."""
    nk, df = len(batch.problems), batch.machines
    sources = {id(b): b for b, _ in taken.values()}
    for i, b in enumerate(sources.values()):
        df = df.join(b.machines.select("machine_id", F.col("state").alias(f"s{i}")), "machine_id", "left")
    order, sizes = list(sources), [len(b.problems) for b in sources.values()]
    moves = [(k, order.index(id(b)), i) for k, (b, i) in taken.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            state = np.frombuffer(b"".join(some.column(1).to_pylist())).reshape(some.num_rows, nk, -1).copy()
            others = [np.frombuffer(b"".join(x or bytes(48 * n) for x in some.column(2 + i).to_pylist())).reshape(some.num_rows, n, -1) for i, n in enumerate(sizes)]
            for k, source, i in moves:
                state[:, k, 0:2], state[:, k, 2:4] = others[source][:, i, 0:2], 0
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in state], pa.binary())], ["machine_id", "state"])

    batch.machines = kept(df.mapInArrow(run, "machine_id string, state binary"))


def fit_ridge(cutting: DataFrame, target: str = "log_vibration_rms_g", alpha: float = 1.0, p: Params = Params(backend="iterated")) -> Linear:
    return fit_all(cutting, [Fit("ridge", target)], replace(p, ridge_alpha=alpha))[0][0]


def fit_huber(cutting: DataFrame, target: str = "log_vibration_rms_g", epsilon: float = 1.35, rounds: int = 100) -> Linear:
    """Iteratively reweighted least squares with a MAD scale, until the prediction stays."""
    return fit_all(cutting, [Fit("huber", target)], Params(backend="iterated", huber_epsilon=epsilon, huber_rounds=rounds))[0][0]


def fit_joint_huber(cutting: DataFrame, target: str = "log_vibration_rms_g", epsilon: float = 1.35) -> Linear:
    """Least Huber loss over coefficients and scale together."""
    return fit_all(cutting, [Fit("joint_huber", target)], Params(huber_epsilon=epsilon))[0][0]


def fit_ransac(cutting: DataFrame, target: str = "log_vibration_rms_g", trials: int = 120, seed: int = 7) -> Linear:
    return fit_all(cutting, [Fit("ransac", target)], Params(backend="iterated", ransac_trials=trials, random_state=seed))[0][0]


def fit_primary(cutting: DataFrame, p: Params = Params(), target: str = "log_vibration_rms_g") -> Linear:
    return fit_all(cutting, [asked(p.primary_model, p, target=target)], p)[0][0]


def cross_validated_r2(cutting: DataFrame, models: list[str] = ("ridge", "huber", "ransac"), target: str = "log_vibration_rms_g", folds: int = 5, p: Params = Params()) -> DataFrame:
    """(model, fold, r2): each model fitted without each fold, all fits in the same passes, and
    judged on it. A fold without rows is left out, one without spread has no r2."""
    fits = [asked(m, p, target=target, left_out=f) for m in models for f in range(folds)]
    _, batch = fit_all(cutting, fits, p, folds)
    parts, nk = len(batch.rows.parts), len(fits)
    lines = [_lines(point.theta, parts) for point in batch.points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((nk, 4))
        for some, starts, of in _runs(batches):
            states = _states(some, starts, nk)
            x, q, part, fold, y = (_numbers(some, c) for c in ("x0", "q", "part", "fold", "y0"))
            y = y.astype(float)
            for k, f in enumerate(fits):
                use = (fold == f.left_out) & ~np.isnan(y)
                line, state, own = lines[k][part[use]], states[of[use], k], y[use]
                r = own - line[:, 0] - state[:, 0] - (line[:, 1] + state[:, 1]) * x[use] - line[:, 2] * q[use]
                total[k] += len(own), (r * r).sum(), own.sum(), (own * own).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(nk)), *map(pa.array, total.T)], ["k", "n", "lost", "s", "ss"])

    sums = {r["k"]: r for r in batch.joined().mapInArrow(run, "k long, n double, lost double, s double, ss double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "lost", "s", "ss")]).collect()}
    names = [m for m in models for _ in range(folds)]
    out = [(names[k], fits[k].left_out, float(1 - s["lost"] / spread) if (spread := s["ss"] - s["s"] ** 2 / s["n"]) > 0 else None) for k, s in sorted(sums.items()) if s["n"]]
    return cutting.sparkSession.createDataFrame(out, "model string, fold int, r2 double")
