"""Whitening of vectors by eigenvalues and vectors that are updated row by row, merged, and refined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.vectors import usable
from cohorta.scratch import materialize

# Summaries merged by one task in each round.
MERGED = 16
STEP = 2048
EPS = np.finfo(float).eps
# Components with less than this share of the largest eigenvalue have no direction of their own.
LEAST_SHARE = 1e-12
# Entries beyond are not whole numbers in doubles.
LARGEST = float(2**52)


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)), one above each of the ascending poles.

    Each root is given as the number of its nearer pole and the distance from that
    pole, which keeps differences to all poles exact where root and pole are close.
    Weights are positive. A step solves the equation with two poles that agrees in value
    and slope; a step that leaves the bracket is replaced by halving it.
    """
    n = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    middle = (poles + ends) / 2
    at_middle = 1 + (weights / (poles - middle[:, None])).sum(axis=1)
    near = np.arange(n) + (at_middle < 0)
    near[-1] = n - 1
    origin = poles[near]
    delta = poles[None, :] - origin[:, None]
    low = np.where(at_middle >= 0, poles - origin, middle - origin)
    high = np.where(at_middle >= 0, middle - origin, ends - origin)
    x = (low + high) / 2
    rows, lower = np.arange(n), np.arange(n)
    upper = np.minimum(lower + 1, n - 1)
    todo = rows
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(60):
            gaps = delta[todo] - x[todo, None]
            terms = weights / gaps
            slopes = terms / gaps
            f = 1 + terms.sum(axis=1)
            low[todo] = np.where(f < 0, x[todo], low[todo])
            high[todo] = np.where(f >= 0, x[todo], high[todo])
            size = 1 + np.abs(terms).sum(axis=1)
            width = high[todo] - low[todo]
            going = (np.abs(f) > n * EPS * size) & (width > 2 * EPS * np.maximum(np.abs(low[todo]), np.abs(high[todo])))
            if not going.any():
                break
            part = np.flatnonzero(going)
            todo, gaps, slopes, f = todo[part], gaps[part], slopes[part], f[part]
            left, right = gaps[np.arange(len(todo)), lower[todo]], gaps[np.arange(len(todo)), upper[todo]]
            until = np.arange(n)[None, :] <= todo[:, None]
            below, above = (slopes * until).sum(axis=1), (slopes * ~until).sum(axis=1)
            a = (left + right) * f - left * right * (below + above)
            b = left * right * f
            c = f - left * below - right * above
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has a pole on one side only.
            step = np.where(todo == n - 1, left * f / c, step)
            tried = x[todo] + step
            inside = (tried > low[todo]) & (tried < high[todo])
            x[todo] = np.where(inside, tried, (low[todo] + high[todo]) / 2)
    return near, x


@dataclass
class Spectrum:
    """Rows, their mean, and the eigenvalues (ascending) and vectors of the scatter about it."""

    rows: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, row: np.ndarray) -> None:
        """One more row: the scatter grows by the outer product of its gap to the mean."""
        gap = row - self.mean
        self.rows += 1
        self.mean = self.mean + gap / self.rows
        self.update(gap, (self.rows - 1) / self.rows)

    def merge(self, other: Spectrum) -> None:
        """The rows of another spectrum, by one update for each of its values and one for the means."""
        if not other.rows:
            return
        total = self.rows + other.rows
        gap = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, float(value))
        self.update(gap, self.rows * other.rows / total)
        self.mean = self.mean + gap * (other.rows / total)
        self.rows = total

    def update(self, vector: np.ndarray, weight: float) -> None:
        """Add ``weight`` times the outer product of ``vector`` with itself.

        In the basis of the vectors this is a diagonal and a rank-one term. Entries of
        the term that are too small to matter, and all but one of those that belong to
        equal values (rotated into that one), are deflated: their pairs stay as they are.
        The others move to the roots of the secular equation. The new vectors follow
        from the term for which these roots are exact, so they stay orthogonal.
        """
        z = self.vectors.T @ vector
        length = float(z @ z)
        if weight * length <= 0:
            return
        z = z * np.sqrt(weight)
        d, q = self.values, self.vectors
        small = 8 * EPS * max(abs(d[-1]), weight * length)
        moved = np.flatnonzero(np.abs(z) * np.sqrt(weight * length) > small)
        for i in np.flatnonzero(np.diff(d[moved]) <= small):
            # Of two equal values the left one is deflated, the right one may meet the next.
            left, right = moved[i], moved[i + 1]
            r = np.hypot(z[left], z[right])
            c, s = z[right] / r, z[left] / r
            z[left], z[right] = 0.0, r
            q[:, [left, right]] = q[:, [left, right]] @ np.array([[c, s], [-s, c]])
        moved = moved[z[moved] != 0]
        if not len(moved):
            return
        poles = d[moved]
        near, x = secular_roots(poles, z[moved] ** 2)
        # apart[i, j]: root i less pole j.
        apart = (poles[near][:, None] - poles[None, :]) + x[:, None]
        gaps = poles[:, None] - poles[None, :]
        np.fill_diagonal(gaps, 1.0)
        ratio = apart.copy()
        n = len(moved)
        # Root i over the gap of pole i to pole j for i < j, and of pole i + 1 for the others.
        ratio[:-1] /= np.where(np.arange(n)[None, :] <= np.arange(n - 1)[:, None], gaps[1:], gaps[:-1])
        fitted = np.sqrt(np.maximum(np.abs(ratio.prod(axis=0)), np.finfo(float).tiny)) * np.sign(z[moved])
        with np.errstate(divide="ignore", invalid="ignore"):
            turned = fitted[:, None] / -apart.T
        # A root on its pole keeps the pole's vector.
        for column in np.flatnonzero(~np.isfinite(turned).all(axis=0)):
            turned[:, column] = np.arange(n) == near[column]
        turned /= np.sqrt((turned**2).sum(axis=0))
        d[moved] = poles[near] + x
        q[:, moved] = q[:, moved] @ turned
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.rows)], self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, width: int) -> Spectrum:
        flat = np.frombuffer(data, "<f8").copy()
        mean, values, vectors = np.split(flat[1:], [width, 2 * width])
        return cls(int(flat[0]), mean, values, vectors.reshape(width, width))


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``components`` are columns, in falling order of ``values``."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def pack_whole(df: DataFrame, id_col: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(id, x) of the rows that take part: floor(scale * c) + offset as little-endian longs."""
    large = F.exists(vector, lambda c: F.abs(c.cast("double")) * scale >= LARGEST)
    narrow = df.where(usable(vector)).where(~large).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            flat, ends = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            whole, ends = np.floor(scale * flat).astype("<i8") + offset, ends - ends[0]
            packed = pa.array([whole[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "x"])

    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {id_type}, x binary")


def _whole(vectors: list[bytes], width: int, fill: bytes) -> np.ndarray:
    """A matrix of packed vectors; shorter ones end in ``fill``."""
    padded = [v if len(v) == 8 * width else v + fill * (width - len(v) // 8) for v in vectors]
    return np.frombuffer(b"".join(padded), "<i8").reshape(len(padded), width)


def _summaries(rows: DataFrame, summarise: Callable[[Iterator[list]], bytes], name: str) -> DataFrame:
    """One summary (part, data) of each partition of ``rows``, written."""
    numbered = rows.select("x", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def lists() -> Iterator[list]:
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(1)[0].as_py()
                    for at in range(0, batch.num_rows, STEP):
                        yield batch.column(0).slice(at, STEP).to_pylist()

        data = summarise(lists())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["part", "data"])

    return materialize(numbered.mapInArrow(run, "part long, data binary"), name)


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All summaries merged into one, a bounded number of them in a task and one in the driver."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["data"].to_pylist()))
        data = merge([d for _, d in rows])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    last = parts.agg(F.max("part")).first()[0]
    while last:
        up = F.floor(F.col("part") / MERGED).cast("long").alias("up")
        parts = materialize(parts.groupBy(up).applyInArrow(run, "part long, data binary"), "merged")
        last //= MERGED
    found = parts.first()
    return bytes(found["data"]) if found else None


def _add(matrices: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(m, "<f8") for m in matrices], axis=0).astype("<f8").tobytes()


def _gram(fit: DataFrame, width: int, project: Callable[[list], np.ndarray], name: str) -> np.ndarray:
    """The sum of outer products of all projected rows."""

    def summarise(lists: Iterator[list]) -> bytes:
        total = np.zeros((width, width))
        for vectors in lists:
            y = project(vectors)
            total += y.T @ y
        return total.astype("<f8").tobytes()

    data = _merged(_summaries(fit, summarise, name), _add)
    return np.frombuffer(data, "<f8").reshape(width, width).copy()


@dataclass(frozen=True)
class Centre:
    """Exact distances from the mean: rows * x - sums, and that over rows."""

    rows: int
    sums: tuple[int, ...]
    fill: bytes

    def _parts(self, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        floors = np.array([s // self.rows for s in self.sums], np.int64)
        rest = np.array([s % self.rows for s in self.sums], np.int64)
        return _whole(vectors, len(self.sums), self.fill) - floors, rest, floors

    def centred(self, vectors: list[bytes]) -> np.ndarray:
        near, rest, _ = self._parts(vectors)
        return near - rest / self.rows

    def deviations(self, vectors: list[bytes]) -> list[int]:
        """The sum over dimensions of (rows * x - sums) ** 2, in whole numbers of any size."""
        near, rest, _ = self._parts(vectors)
        largest = int(np.abs(near).max(initial=0)) * self.rows + self.rows
        if largest * largest * max(1, len(self.sums)) < 2**63:
            return ((near * self.rows - rest) ** 2).sum(axis=1).tolist()
        return [sum((int(v) * self.rows - int(r)) ** 2 for v, r in zip(row, rest)) for row in near]


def fit_whitening(packed: DataFrame, components: int = 16, fill: int = 0) -> Whitening | None:
    """Mean, leading eigenvectors and eigenvalues of the covariance of the distinct vectors.

    ``packed`` has (id, x). Each distinct vector counts once. Every partition takes its
    rows into a spectrum by rank-one updates; spectra are merged in rounds. Their vectors
    are then the basis in which the whole covariance is formed once more from centred
    rows, and its eigenvectors turn the basis (Rayleigh-Ritz): the result does not
    depend on how exact the updates were. None where there are no rows or all are equal.
    """
    widest = packed.agg(F.max(F.octet_length("x"))).first()[0]
    if not widest:
        return None
    width, pad = widest // 8, np.array([fill], "<i8").tobytes()
    # Rows that end in the filling equal those that leave it out.
    full = F.when(
        F.octet_length("x") < widest,
        F.concat("x", F.unhex(F.repeat(F.lit(pad.hex()), ((widest - F.octet_length("x")) / 8).cast("int")))),
    ).otherwise(F.col("x"))
    # Spread for the updates, which cost far more than the move.
    spread = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = materialize(packed.select(full.alias("x")).distinct().repartition(spread, "x"), "fit-list")
    rows = fit.count()

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = _whole(batch.column(0).slice(at, STEP).to_pylist(), width, pad)
                # Of 2048 numbers below 2 ** 53, so within 64 bits even without the split.
                high, low = x >> 32, x & 0xFFFFFFFF
                sums = [s + (int(h) << 32) + int(v) for s, h, v in zip(sums, high.sum(axis=0), low.sum(axis=0))]
        from decimal import Decimal

        total = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), total], names=["dim", "total"])

    added = fit.mapInArrow(adding, "dim long, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    sums = tuple(int(r["total"]) for r in sorted(added, key=lambda r: r["dim"]))
    centre = Centre(rows, sums, pad)

    def spectrum(lists: Iterator[list]) -> bytes:
        found = Spectrum.empty(width)
        for vectors in lists:
            # Any fixed shift leaves the scatter; a small one keeps its digits.
            for row in centre.centred(vectors):
                found.add(row)
        return found.to_bytes()

    def merging(parts: list[bytes]) -> bytes:
        first, *others = (Spectrum.from_bytes(p, width) for p in parts)
        for other in others:
            first.merge(other)
        return first.to_bytes()

    data = _merged(_summaries(fit, spectrum, "spectra"), merging)
    basis = Spectrum.from_bytes(data, width).vectors[:, ::-1]
    covariance = _gram(fit, width, lambda vectors: centre.centred(vectors) @ basis, "projected") / rows
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    count = min(components, int((values > LEAST_SHARE * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    if not count:
        return None
    vectors = basis @ turn[:, :count]
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    scaled = vectors / np.sqrt(values[:count])
    seen = _gram(fit, count, lambda rows_: centre.centred(rows_) @ scaled, "whitened") / rows
    error = float(np.abs(seen - np.eye(count)).max())
    return Whitening(rows, sums, values[:count].copy(), vectors, float(np.trace(covariance)), error)


def whiten(
    df: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    offset: int = 1_000_000,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), ``components`` rows of each row of ``df``.

    Entries c become x = floor(scale * c) + offset. The fit counts each distinct vector
    x once: ``n`` of them. ``whitened`` is x less the mean, projected on the component
    and divided by the root of its eigenvalue; ``explained`` the eigenvalue's share of the
    trace; ``deviation`` the exact sum of (n * x - sums) ** 2, a decimal;
    ``identity_error`` the largest entry by which the covariance of the whitened fit list
    differs from the identity, measured by a pass of its own.

    Rows whose vector is null, holds a null or non-finite entry, or one of 2 ** 52 / scale
    or more, are left out; shorter vectors end in zeros. Null and repeated ids are rows
    like others. There are only as many components as directions in which the vectors
    differ: none, hence no rows, if all are equal or the table is empty. Other columns do not matter.
    """
    spark = df.sparkSession
    packed = materialize(pack_whole(df, id_col, vector, scale, offset), "whole")
    id_type = packed.schema["id"].dataType.simpleString()
    fields = (
        f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    fitted = fit_whitening(packed, components, fill=offset)
    if fitted is None:
        return spark.createDataFrame([], fields)
    shared = spark.sparkContext.broadcast(fitted)
    fill = np.array([offset], "<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        model: Whitening = shared.value
        centre, count = Centre(model.rows, model.sums, fill), len(model.values)
        scaled = model.components / np.sqrt(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                vectors = part.column(1).to_pylist()
                n = len(vectors)
                exact = [Decimal(v) if v < 10**38 else None for v in centre.deviations(vectors)]
                deviations = pa.array(exact, pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(n), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * count, model.rows)),
                        deviations.take(each),
                        pa.array((centre.centred(vectors) @ scaled).ravel()),
                        pa.array(np.tile(model.explained, n)),
                        pa.array(np.full(n * count, model.identity_error)),
                    ],
                    names=[f.split()[0] for f in fields.split(", ")],
                )

    return packed.mapInArrow(run, fields)
