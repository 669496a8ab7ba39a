"""Many weighted least-squares steps side by side, with the machines eliminated on the executors.

A reading's prediction is a global part (intercept, slopes on log power x and quantity q, shift
and slope per part) and the shift and slope of its machine. A step of any of the fits solves
weighted normal equations. In these a machine's two unknowns meet only each other and the
global ones: the matrix is bordered. So each machine's 2 x 2 block is eliminated where its sums
are, and the driver adds up and solves what is left, 3 + 2 x parts unknowns (and the scale of a
joint fit), however many machines there are. Machines' coefficients stay a table; rows meet
them by a join.

Problems (targets, folds, kinds of loss, trials) are columns of one set of sums: a pass over the
rows serves all of them, each at several candidate points, of which the driver takes the best.
Rows are laid out once by ranges of machines, so a task holds the sums of a few machines at a
time and a machine with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearloom.functions.tables import kept

#: Row keys by which samples and folds are drawn, so that they do not depend on how rows lie.
KEYS = ("machine_id", "ts")
#: Sums of a machine's rows of a part: curvature over (1, x, q), gradient, coupling with the scale, loss and its derivatives by the scale.
W, WX, WQ, WXX, WXQ, WQQ, G, GX, GQ, C, CX, CQ, LOSS, LS, LSS = range(15)
SUMS = 15
#: Machines whose sums a task works on at a time, and machines per task when sums are merged.
RUNS, MERGED = 256, 4096
#: Share of the majorising curvature that rows in the linear zone of a joint loss lend to a step:
#: the first, the least and the factor by which it grows after a step cut short, or falls after a whole one.
DAMPING, LEAST_DAMPING, DAMPING_FACTOR = 0.05, 0.002, 5.0
STATE = 6  #: of a machine and problem: shift, slope, their steps, their penalties


def measure(column: str) -> Column:
    """A measure of the design; what is null or not finite counts as 0."""
    x = F.col(column).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(0.0))


def finite(column: str) -> Column:
    """A target; what is null or not finite is null."""
    y = F.col(column).cast("double")
    return F.when(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")), y)


@dataclass(frozen=True)
class Problem:
    """One fit. kind: "squares", "joint" (Huber loss of coefficients and scale together),
    "reweighted" (squares with weights of the residuals at the point reached) or "inliers"
    (squares over rows whose residual there is within a limit). alpha penalises squared
    coefficients: of the whole standardised design if ``scaled``, else only log power and quantity
    are standardised. left_out is a fold that is not learned from; trial draws a share of the rows.
    """

    target: str = "log_vibration_rms_g"
    power: str = "log_net_power_kw"
    kind: str = "squares"
    alpha: float = 1.0
    scaled: bool = True
    left_out: int | None = None
    epsilon: float = 1.35
    trial: int | None = None
    share: float = 1.0


class Rows:
    """The numbers of all readings, laid out by machine, and what is known of parts and forms.
    forms: (target, measure of power) of the fits; form i's columns are y<i> and x<i>."""

    def __init__(self, cutting: DataFrame, forms: list[tuple[str, str]], folds: int = 0, seed: int = 7):
        fold = F.pmod(F.xxhash64(*KEYS), F.lit(folds)) if folds else F.lit(0)
        tagged = cutting.select(
            "machine_id", "part_type", fold.cast("int").alias("fold"), F.xxhash64(F.lit(seed), *KEYS).alias("h"), measure("quantity").alias("q"),
            *[c for i, (target, power) in enumerate(forms) for c in (measure(power).alias(f"x{i}"), finite(target).alias(f"y{i}"))],
        )
        self.spark, self.forms = cutting.sparkSession, forms
        q, sums = F.col("q"), []
        for i in range(len(forms)):
            has, x = F.col(f"y{i}").isNotNull(), F.col(f"x{i}")
            of = {"n": F.lit(1.0), "x": x, "xx": x * x, "q": q, "qq": q * q}
            sums += [F.sum(F.when(has, e)).alias(f"{k}{i}") for k, e in of.items()] + [F.min(F.when(has, F.col("machine_id"))).alias(f"first{i}")]
        self.survey = [r.asDict() for r in tagged.groupBy("part_type", "fold").agg(F.approx_count_distinct("machine_id").alias("machines"), *sums).collect()]
        self.parts = sorted({r["part_type"] for r in self.survey if r["part_type"] is not None}) or [None]
        self.tasks = 1 + max((r["machines"] for r in self.survey), default=0) // MERGED
        place = F.create_map(*[F.lit(v) for i, p in enumerate(self.parts) for v in (p, i)])[F.col("part_type")] if self.parts != [None] else F.lit(0)
        numbered = tagged.withColumn("part", F.coalesce(place, F.lit(0))).drop("part_type")
        self.df = kept(numbered.repartitionByRange("machine_id", "h").sortWithinPartitions("machine_id"))

    def form(self, p: Problem) -> int:
        return self.forms.index((p.target, p.power))

    @property
    def size(self) -> int:
        """Global unknowns, with the scale as the last."""
        return 4 + 2 * (len(self.parts) - 1)

    def known(self, p: Problem) -> dict:
        """Count, deviations of the global columns and the first machine of a problem's rows."""
        i, own = self.form(p), [r for r in self.survey if p.left_out is None or r["fold"] != p.left_out]
        add = lambda k, part=None: sum(r[f"{k}{i}"] or 0.0 for r in own if part is None or r["part_type"] == part)
        n = add("n")
        dev = lambda mean, square: (v if n and (v := np.sqrt(max(square / n - (mean / n) ** 2, 0.0))) >= 1e-12 else 1.0)
        parts = self.parts[1:]
        found = [1.0, dev(add("x"), add("xx")), dev(add("q"), add("qq"))]
        found += [dev(add("n", k), add("n", k)) if p.scaled else 1.0 for k in parts] + [dev(add("x", k), add("xx", k)) if p.scaled else 1.0 for k in parts]
        penalty = p.alpha * np.array(found) ** 2
        penalty[0] = 0.0
        return {"n": n, "penalty": np.r_[penalty, 0.0], "first": min((r[f"first{i}"] for r in own if r[f"first{i}"] is not None), default=None)}


def _lines(theta: np.ndarray, parts: int) -> np.ndarray:
    """Per part: shift, slope on x, slope on q."""
    out = np.tile(theta[:3], (parts, 1))
    out[1:, 0] += theta[3 : 2 + parts]
    out[1:, 1] += theta[2 + parts : 1 + 2 * parts]
    return out


@dataclass
class Point:
    """Where a problem is: global coefficients (the scale last), the step from there, and the
    candidates that the next pass looks at, as (step length, scale)."""

    theta: np.ndarray
    step: np.ndarray
    tried: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 1.0)])
    kind: str = "squares"
    limit: float = 0.0  #: of a residual, for reweighted rows and inliers
    active: bool = True
    loss: float = np.inf
    drop: float = np.inf  #: that the last step promises
    rounds: int = 0
    damping: float = DAMPING


def _terms(kind: str, r: np.ndarray, sigma: float, epsilon: float, limit: float, damping: float = DAMPING):
    """(curvature, gradient by the prediction, coupling with the scale, loss, its derivatives by the scale)."""
    zero = np.zeros_like(r)
    if kind == "joint":
        near = np.abs(r) <= epsilon * sigma
        size = np.maximum(np.abs(r), 1e-300)
        w = np.where(near, 2 / sigma, damping * 2 * epsilon / size)
        g = np.where(near, -2 * r / sigma, -2 * epsilon * np.sign(r))
        c = np.where(near, 2 * r / sigma**2, 0.0)
        loss = np.where(near, sigma + r * r / sigma, sigma * (1 - epsilon**2) + 2 * epsilon * size)
        return w, g, c, loss, np.where(near, 1 - (r / sigma) ** 2, 1 - epsilon**2), np.where(near, 2 * r * r / sigma**3, 0.0)
    weight = np.ones_like(r)
    if kind == "reweighted":
        weight = np.minimum(1.0, limit / np.maximum(np.abs(r), 1e-300))
    elif kind == "inliers":
        weight = (np.abs(r) <= limit).astype(float)
    return 2 * weight, -2 * weight * r, zero, weight * r * r, zero, zero


def drawn(h: np.ndarray, trial: int, share: float) -> np.ndarray:
    """Rows of a trial's sample, by their hash."""
    mixed = (h.view(np.uint64) ^ np.uint64(trial * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(np.float64) / 2**53 < share


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, first row of each machine in them, machine's number per row), RUNS machines at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = _numbers(batch, "machine_id").astype(object)
        starts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
        for at in range(0, len(starts), RUNS):
            own = starts[at : at + RUNS]
            end = starts[at + RUNS] if at + RUNS < len(starts) else batch.num_rows
            some = batch.slice(own[0], end - own[0])
            own = own - own[0]
            yield some, own, np.repeat(np.arange(len(own)), np.diff(np.r_[own, some.num_rows]))


def _states(batch: pa.RecordBatch, starts: np.ndarray, problems: int) -> np.ndarray:
    found = batch.column(batch.schema.get_field_index("state")).take(pa.array(starts)).to_pylist()
    empty = bytes(8 * STATE * problems)
    return np.frombuffer(b"".join(x or empty for x in found)).reshape(len(starts), problems, STATE)


class Batch:
    """Problems over the same rows, stepped together."""

    def __init__(self, rows: Rows, problems: list[Problem]):
        self.rows, self.problems = rows, problems
        self.known = [rows.known(p) for p in problems]
        self.points = [Point(np.zeros(rows.size), np.zeros(rows.size)) for _ in problems]
        self.machines: DataFrame | None = None  #: (machine_id, state)

    def joined(self, *columns: str) -> DataFrame:
        """Rows with their machine's state; a table that Spark broadcasts if it is small."""
        df = self.rows.df
        if columns:
            df = df.select(*columns)
        if self.machines is None:
            return df.withColumn("state", F.lit(None).cast("binary"))
        return df.join(self.machines, "machine_id", "left")

    def residuals(self, k: int):
        """Residual of problem k at its point, from batches of (machine_id, part, x, q, y, state)."""
        lines, problems = _lines(self.points[k].theta, len(self.rows.parts)), len(self.problems)

        def of(batch: pa.RecordBatch) -> np.ndarray:
            out = [np.zeros(0)]
            for some, starts, run in _runs([batch]):
                own, state = lines[_numbers(some, "part")], _states(some, starts, problems)[:, k][run]
                x, q, y = (_numbers(some, c) for c in ("x", "q", "y"))
                out.append(y - own[:, 0] - state[:, 0] - (own[:, 1] + state[:, 1]) * x - own[:, 2] * q)
            return np.concatenate(out)

        return of

    def target_rows(self, k: int) -> DataFrame:
        """Rows of problem k with its target as y, and their machine's state."""
        p = self.problems[k]
        i = self.rows.form(p)
        own = self.rows.df.where(F.col(f"y{i}").isNotNull())
        if p.left_out is not None:
            own = own.where(F.col("fold") != p.left_out)
        own = own.select("machine_id", "part", F.col(f"x{i}").alias("x"), "q", F.col(f"y{i}").alias("y"))
        return own.withColumn("state", F.lit(None).cast("binary")) if self.machines is None else own.join(self.machines, "machine_id", "left")

    def scan(self) -> DataFrame:
        """(machine_id, state, sums): partial sums of each machine, from every task that has rows of it."""
        problems, points, parts = self.problems, self.points, len(self.rows.parts)
        forms, count = [self.rows.form(p) for p in problems], len(self.rows.forms)
        width = max(len(p.tried) for p in points)
        lines = [[_lines(p.theta + t * p.step, parts) for t, _ in p.tried] for p in points]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch, starts, of in _runs(batches):
                q, part = _numbers(batch, "q"), _numbers(batch, "part")
                fold, h = _numbers(batch, "fold"), _numbers(batch, "h")
                states = _states(batch, starts, len(problems))
                total = np.zeros((len(starts), len(problems), width, parts, SUMS))
                both = [(_numbers(batch, f"x{i}"), _numbers(batch, f"y{i}").astype(float)) for i in range(count)]
                for k, (p, point) in enumerate(zip(problems, points)):
                    if not point.active:
                        continue
                    x, y = both[forms[k]]
                    use = ~np.isnan(y)
                    if p.left_out is not None:
                        use &= fold != p.left_out
                    if p.trial is not None:
                        use &= drawn(h, p.trial, p.share)
                    use = np.flatnonzero(use)
                    xs, qs, y, own, run_of = x[use], q[use], y[use], part[use], of[use]
                    state, at = states[run_of, k], run_of * parts + own
                    for j, (t, sigma) in enumerate(point.tried):
                        line = lines[k][j][own]
                        shift, slope = state[:, 0] + t * state[:, 2], state[:, 1] + t * state[:, 3]
                        r = y - line[:, 0] - shift - (line[:, 1] + slope) * xs - line[:, 2] * qs
                        w, g, c, loss, ls, lss = _terms(point.kind, r, sigma, p.epsilon, point.limit, point.damping)
                        wx, wq = w * xs, w * qs
                        for s, term in enumerate((w, wx, wq, wx * xs, wx * qs, wq * qs, g, g * xs, g * qs, c, c * xs, c * qs, loss, ls, lss)):
                            total[:, k, j, :, s] = np.bincount(at, term, len(starts) * parts).reshape(len(starts), parts)
                names = batch.column(batch.schema.get_field_index("machine_id")).take(pa.array(starts)).to_pylist()
                made = [[n, s.tobytes(), t] for n, s, t in zip(names, states, total)]
                if held and held[0] == made[0][0]:
                    made[0][2] = made[0][2] + held[2]
                elif held:
                    made.insert(0, held)
                held = made.pop()
                yield packed(made)
            if held:
                yield packed([held])

        def packed(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2].tobytes() for m in made], pa.binary())], ["machine_id", "state", "sums"])

        return self.joined().mapInArrow(run, "machine_id string, state binary, sums binary")

    def eliminated(self, first: bool) -> DataFrame:
        """(machine_id, theta, back, penalty) per machine, and one row per task, with border, of
        what the elimination leaves for the driver."""
        nk, parts, g, width = len(self.problems), len(self.rows.parts), self.rows.size, max(len(p.tried) for p in self.points)
        lengths = np.zeros((nk, width))
        for k, p in enumerate(self.points):
            lengths[k, : len(p.tried)] = [t for t, _ in p.tried]
        alpha, scaled = np.array([p.alpha for p in self.problems]), np.array([p.scaled for p in self.problems])
        n, pinned = np.array([max(k["n"], 1.0) for k in self.known]), [k["first"] for k in self.known]

        def blocks(batches: Iterator[pa.RecordBatch]):
            """(names, states, sums) of some whole machines; rows come sorted by machine."""
            names, states, sums = [], [], []
            for batch in batches:
                for name, state, own in zip(*(c.to_pylist() for c in batch.columns)):
                    own = np.frombuffer(own).reshape(nk, width, parts, SUMS)
                    if names and names[-1] == name:
                        sums[-1] = sums[-1] + own
                        continue
                    if len(names) == RUNS:
                        yield names, np.array(states), np.array(sums)
                        names, states, sums = [], [], []
                    names.append(name)
                    states.append(np.frombuffer(state).reshape(nk, STATE))
                    sums.append(own)
            if names:
                yield names, np.array(states), np.array(sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            border = np.zeros(nk * width * (parts * SUMS + g * g + g + 2))
            left = [border[a:b].reshape(shape) for a, b, shape in _layout(nk, width, parts, g)]
            for names, state, sums in blocks(batches):
                total = sums.sum(axis=3)  # machine, problem, candidate, sum
                theta = state[:, :, None, 0:2] + lengths[None, :, :, None] * state[:, :, None, 2:4]
                if first:
                    own = total[:, :, 0] / 2 / n[None, :, None]
                    var = np.stack([own[..., W] - own[..., W] ** 2, own[..., WXX] - own[..., WX] ** 2], -1)
                    penalty = np.where(scaled[None, :, None] & (np.sqrt(np.maximum(var, 0)) >= 1e-12), var, 1.0) * alpha[None, :, None]
                else:
                    penalty = state[:, :, 4:6]
                free = np.array([[name is not None and name != pin for pin in pinned] for name in names], float)[:, :, None]
                a, b, d = total[..., W] + 2 * penalty[:, :, None, 0], total[..., WX], total[..., WXX] + 2 * penalty[:, :, None, 1]
                det = a * d - b * b
                inverse = np.stack([np.stack([d, -b], -1), np.stack([-b, a], -1)], -2) * (free / np.where(det > 0, det, np.inf))[..., None, None]
                slope = np.stack([total[..., G], total[..., GX]], -1) + 2 * penalty[:, :, None] * theta
                couple = np.zeros((*total.shape[:3], 2, g))
                couple[..., 0, :3], couple[..., 1, :3] = total[..., [W, WX, WQ]], total[..., [WX, WXX, WXQ]]
                couple[..., 0, 3 : 2 + parts], couple[..., 1, 3 : 2 + parts] = sums[..., 1:, W], sums[..., 1:, WX]
                couple[..., 0, 2 + parts : 1 + 2 * parts], couple[..., 1, 2 + parts : 1 + 2 * parts] = sums[..., 1:, WX], sums[..., 1:, WXX]
                couple[..., 0, -1], couple[..., 1, -1] = total[..., C], total[..., CX]
                back = inverse @ np.concatenate([slope[..., None], couple], -1)  # machine, problem, candidate, 2, 1 + g
                left[0] += sums.sum(axis=0)
                left[1] += np.einsum("mkjig,mkjih->kjgh", couple, back[..., 1:])
                left[2] += np.einsum("mkjig,mkji->kjg", couple, back[..., 0])
                left[3] += np.einsum("mkji,mkji->kj", slope, back[..., 0])
                left[4] += np.einsum("mkji,mki->kj", theta * theta * free[..., None], penalty)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), *(pa.array([np.ascontiguousarray(x).tobytes() for x in xs], pa.binary()) for xs in (theta, back, penalty)), pa.nulls(len(names), pa.binary())],
                    ["machine_id", "theta", "back", "penalty", "border"],
                )
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([border.tobytes()], pa.binary())], ["machine_id", "theta", "back", "penalty", "border"])

        merged = self.scan().repartition(self.rows.tasks, "machine_id").sortWithinPartitions("machine_id")
        return kept(merged.mapInArrow(run, "machine_id string, theta binary, back binary, penalty binary, border binary"))

    def step(self, first: bool = False) -> None:
        """One pass: takes each active problem's best candidate and finds the step from there."""
        nk, parts, g, width = len(self.problems), len(self.rows.parts), self.rows.size, max(len(p.tried) for p in self.points)
        table = self.eliminated(first)
        total = np.zeros(nk * width * (parts * SUMS + g * g + g + 2))
        for row in table.where("border IS NOT NULL").select("border").collect():  # one row per task, of a fixed size
            total += np.frombuffer(row[0])
        sums, schur, right, gain, lost = (total[a:b].reshape(shape) for a, b, shape in _layout(nk, width, parts, g))
        chosen, steps = np.zeros(nk, int), np.zeros((nk, 1 + g))
        for k, (point, known) in enumerate(zip(self.points, self.known)):
            if not point.active:
                continue
            at = lambda j: point.theta + point.tried[j][0] * point.step  # noqa: B023, E731
            losses = [sums[k, j, :, LOSS].sum() + lost[k, j] + known["penalty"] @ at(j) ** 2 for j in range(len(point.tried))]
            j = chosen[k] = int(np.argmin(losses))
            point.theta, point.loss = at(j), losses[j]
            point.damping = min(1.0, max(LEAST_DAMPING, point.damping * (DAMPING_FACTOR if point.tried[j][0] < 1 else 1 / DAMPING_FACTOR)))
            point.theta[-1] = point.tried[j][1]
            gram, slope = _normal(sums[k, j], parts, g)
            gram = gram + 2 * np.diag(known["penalty"]) - schur[k, j]
            want = -(slope + 2 * known["penalty"] * point.theta) + right[k, j]
            some = slice(0, g if point.kind == "joint" else g - 1)
            size = np.sqrt(np.maximum(np.diag(gram)[some], 0))
            size = np.where(size > 0, size, 1.0)
            point.step = np.zeros(g)
            point.step[some] = np.linalg.lstsq(gram[some, some] / np.outer(size, size), want[some] / size, rcond=None)[0] / size
            point.drop = max(0.5 * (want @ point.step + gain[k, j]), 0.0)
            point.rounds += 1
            steps[k] = np.r_[1.0, point.step]
        self._move(table, chosen, steps, settle=False)

    def settle(self, *problems: int) -> None:
        """Takes the whole last step of problems; these take part in passes no more."""
        nk = len(self.problems)
        for k in problems:
            self.points[k].theta = self.points[k].theta + self.points[k].step
            self.points[k].step = np.zeros(self.rows.size)
        done = np.isin(np.arange(nk), problems)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                state = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, nk, STATE).copy()
                state[:, done, 0:2] += state[:, done, 2:4]
                state[:, done, 2:4] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in state], pa.binary())], ["machine_id", "state"])

        self.machines = self.machines.mapInArrow(run, "machine_id string, state binary")

    def _move(self, table: DataFrame, chosen: np.ndarray, steps: np.ndarray, settle: bool) -> None:
        """Machines' coefficients at the chosen candidates, and their own steps, by substitution."""
        nk, g, width = len(self.problems), self.rows.size, max(len(p.tried) for p in self.points)
        k = np.arange(nk)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = lambda i, *shape: np.frombuffer(b"".join(batch.column(i).to_pylist())).reshape(-1, *shape)  # noqa: B023, E731
                theta, back, penalty = own(1, nk, width, 2)[:, k, chosen], own(2, nk, width, 2, 1 + g)[:, k, chosen], own(3, nk, 2)
                state = np.concatenate([theta, -np.einsum("mkig,kg->mki", back, steps), penalty], -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in state], pa.binary())], ["machine_id", "state"])

        wanted = table.where("machine_id IS NOT NULL").select("machine_id", "theta", "back", "penalty")
        self.machines = wanted.mapInArrow(run, "machine_id string, state binary")

    def coefficients(self) -> DataFrame:
        """(machine_id, shifts, slopes): what each machine adds, an array over the problems."""
        nk = len(self.problems)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.float64())
            for batch in batches:
                state = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, nk, STATE)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(state[:, :, i].tolist(), kind) for i in (0, 1))], ["machine_id", "shifts", "slopes"])

        return kept(self.machines.mapInArrow(run, "machine_id string, shifts array<double>, slopes array<double>"))


def _layout(nk: int, width: int, parts: int, g: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """Places of the sums, the eliminated curvature and gradient, the gain and the penalty in a border row."""
    out, at = [], 0
    for shape in ((nk, width, parts, SUMS), (nk, width, g, g), (nk, width, g), (nk, width), (nk, width)):
        size = int(np.prod(shape))
        out.append((at, at + size, shape))
        at += size
    return out


def _normal(sums: np.ndarray, parts: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and gradient of the global unknowns from the sums per part."""
    gram, slope, total = np.zeros((g, g)), np.zeros(g), sums.sum(axis=0)
    gram[:3, :3] = total[[[W, WX, WQ], [WX, WXX, WXQ], [WQ, WXQ, WQQ]]]
    slope[:3], slope[-1] = total[[G, GX, GQ]], total[LS]
    gram[:3, -1] = gram[-1, :3] = total[[C, CX, CQ]]
    gram[-1, -1] = total[LSS]
    for p in range(1, parts):
        i, j, own = 2 + p, 1 + parts + p, sums[p]
        gram[:3, i] = gram[i, :3] = own[[W, WX, WQ]]
        gram[:3, j] = gram[j, :3] = own[[WX, WXX, WXQ]]
        gram[i, i], gram[j, j] = own[W], own[WXX]
        gram[i, j] = gram[j, i] = own[WX]
        gram[i, -1] = gram[-1, i] = own[C]
        gram[j, -1] = gram[-1, j] = own[CX]
        slope[i], slope[j] = own[G], own[GX]
    return gram, slope
