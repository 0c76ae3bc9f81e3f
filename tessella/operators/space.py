"""Geometry: feature grids, regions of interest, control points, response maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import border_distance, distance, draw
from tessella.operators.ranking import spread_out, task_count


def grid_edges(size: float, patch: float, step: float) -> list[float]:
    """Left edges of the patches that fit an image of a size centred on 0, with a patch around each centre."""
    n = int(np.floor((size - step) / step)) + 1
    return [float(-size / 2 + step / 2 + i * step - patch / 2) for i in range(n)]


def grid_cell(v: Column, start: float, step: float) -> Column:
    """The cell that holds v, its lower edge included."""
    return F.floor((v - start) / step).cast("long")


def grid_lookup(events: DataFrame, grid: DataFrame, background: list[float], start: tuple[float, float], step: float, image: str = "image", x: str = "x", y: str = "y", feature: str = "feat") -> DataFrame:
    """Each event's feature: that of its cell, or the background where the grid has none.

    ``grid`` has image, ix, iy and the feature.
    """
    at = events.withColumn("ix", grid_cell(F.col(x), start[0], step)).withColumn("iy", grid_cell(F.col(y), start[1], step))
    return at.join(grid.select(image, "ix", "iy", feature), [image, "ix", "iy"], "left").withColumn(feature, F.coalesce(feature, F.array(*[F.lit(float(v)) for v in background])))


def scaled_boxes(boxes: DataFrame, width: Column, height: Column, dilate: float) -> DataFrame:
    """(image, x1, y1, x2, y2) out of x, y, w, h in an image of image_w by image_h, scaled to a presented size centred on 0 and grown.

    More than one box of an image isn't supported and fails the job.
    """
    sx, sy = width / F.col("image_w"), height / F.col("image_h")
    one = boxes.groupBy("image").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("x", "y", "w", "h", "image_w", "image_h")])
    checked = one.withColumn("x", F.when(F.col("n") == 1, F.col("x")).otherwise(F.raise_error(F.lit("an image has more than one box"))))
    return checked.select(
        "image", (F.col("x") * sx - width / 2 - dilate).alias("x1"), (F.col("y") * sy - height / 2 - dilate).alias("y1"),
        ((F.col("x") + F.col("w")) * sx - width / 2 + dilate).alias("x2"), ((F.col("y") + F.col("h")) * sy - height / 2 + dilate).alias("y2"),
    )


def roi_hits(events: DataFrame, boxes: DataFrame, cells: DataFrame | None = None, cell_size: float = 1.0, image: str = "image", x: str = "x", y: str = "y") -> DataFrame:
    """``hit`` and ``component``: in the dilated mask if the image has one, else in its box, else false.

    ``boxes`` has one row for an image; ``cells`` has image, px, py and component.  Cells grow with the
    images and their number is guessed far too low, so neither they nor their images are ever broadcast.
    """
    met = events.join(boxes, image, "left")
    inside = (F.col(x) >= F.col("x1")) & (F.col(x) <= F.col("x2")) & (F.col(y) >= F.col("y1")) & (F.col(y) <= F.col("y2"))
    if cells is None:
        return met.withColumn("hit", F.coalesce(inside, F.lit(False))).withColumn("component", F.when(F.col("hit"), 0)).drop("x1", "y1", "x2", "y2")
    masked = cells.select(image).distinct().withColumn("_masked", F.lit(True)).hint("shuffle_merge")
    at = met.withColumn("px", grid_cell(F.col(x), 0.0, cell_size)).withColumn("py", grid_cell(F.col(y), 0.0, cell_size))
    at = at.join(masked, image, "left").join(cells.select(image, "px", "py", F.col("component").alias("_c")).hint("shuffle_merge"), [image, "px", "py"], "left")
    component = F.when(F.coalesce("_masked", F.lit(False)), F.col("_c")).when(inside, 0)
    return at.withColumn("component", component).withColumn("hit", F.col("component").isNotNull()).drop("x1", "y1", "x2", "y2", "_c", "_masked", "px", "py")


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a mask in reading order: line, first and last column."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    line, first = np.nonzero(edges == 1)
    return line, first, np.nonzero(edges == -1)[1] - 1


def run_components(line: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """4-connected components of runs in reading order, numbered from 1 in that order.

    Runs of neighbouring lines are joined where they overlap.
    """
    width = int(last.max(initial=0)) + 2
    lo = np.searchsorted(line * width + last, (line + 1) * width + first)
    hi = np.searchsorted(line * width + first, (line + 1) * width + last, "right")
    above = np.repeat(np.arange(len(line)), np.maximum(hi - lo, 0))
    below = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True) if x < y] or [np.zeros(0, np.int64)])
    least = np.arange(len(line))
    while True:  # the least run of each component spreads, by jumps
        new = least.copy()
        np.minimum.at(new, above, least[below])
        np.minimum.at(new, below, least[above])
        new = new[new]
        if (new == least).all():
            return np.unique(least, return_inverse=True)[1] + 1
        least = new


def dilate(components: np.ndarray, radius: int) -> np.ndarray:
    """Components grown by a disc; the canvas grows by the radius on every side, and a cell goes to the nearest component.

    Of equally near ones the smaller number wins, so ids survive.  Each line first finds its
    nearest on either side, then lines up to the radius away are compared.
    """
    big = np.pad(components.astype(np.int64), radius)
    height, width = big.shape
    at, none = np.arange(width), 4 * (width + height + radius)
    left = np.maximum.accumulate(np.where(big > 0, at, -none), axis=1)
    right = np.minimum.accumulate(np.where(big > 0, at, none + width)[:, ::-1], axis=1)[:, ::-1]
    ids = [np.take_along_axis(big, np.clip(x, 0, width - 1), 1) for x in (left, right)]
    far_left, far_right = at - left, right - at
    take_left = (far_left < far_right) | ((far_left == far_right) & (ids[0] <= ids[1]))
    near, own = np.where(take_left, far_left, far_right), np.where(take_left, ids[0], ids[1])
    out, best = np.zeros_like(big), np.full(big.shape, radius * radius + 1)
    for down in range(-radius, radius + 1):
        to, of = slice(max(0, down), height + min(0, down)), slice(max(0, -down), height + min(0, -down))
        far = near[of] ** 2 + down * down
        nearer = (far < best[to]) | ((far == best[to]) & (far <= radius * radius) & (own[of] < out[to]))
        out[to][nearer], best[to][nearer] = own[of][nearer], far[nearer]
    return out


def _grown(line: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    """Runs of the grown components of runs in reading order: py, x0, x1, component."""
    low, left = int(line.min()), int(first.min())
    ids = run_components(line - low, first - left, last - left)
    canvas = np.zeros((int(line.max()) - low + 1, int(last.max()) - left + 2), np.int64)
    np.add.at(canvas, (line - low, first - left), ids)
    np.add.at(canvas, (line - low, last - left + 1), -ids)
    grown = dilate(canvas.cumsum(1)[:, :-1], radius)
    cut = np.pad(grown, ((0, 0), (1, 1)))
    change = cut[:, 1:] != cut[:, :-1]
    y, x0 = np.nonzero(change[:, :-1] & (grown > 0))
    x1 = np.nonzero(change[:, 1:] & (grown > 0))[1]
    return {"py": y + low - radius, "x0": x0 + left - radius, "x1": x1 + left - radius, "component": grown[y, x0].astype(np.int32)}


#: Cells of a task.
CELLS = 1 << 19
_RUN = "py long, x0 long, x1 long, component int"


def mask_runs(masks: DataFrame, radius: int, threshold: int = 127) -> DataFrame:
    """(image, category, py, x0, x1, component) out of masks (image, category, width, height, pixels): the runs of grown components."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                found = runs_of(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) > threshold)
                if len(found[0]):
                    yield pd.DataFrame({"image": r.image, "category": r.category} | _grown(*found, radius))

    return masks.select("image", "category", "width", "height", "pixels").mapInPandas(runs, f"image long, category string, {_RUN}")


def cell_runs(cells: DataFrame, radius: int, by: list[str]) -> DataFrame:
    """(by, py, x0, x1, component) out of masks that are cells (by, px, py), repeats allowed: the runs of grown components.

    Cells are shuffled once, to tasks of about ``CELLS`` of them whatever their bytes, and become runs in
    Spark; a task holds the runs of one image at a time.
    """
    line = Window.partitionBy(*by, "py")
    dealt = cells.select(*by, "py", "px").repartition(task_count(cells.sparkSession, cells.count() // CELLS), *by)
    numbered = dealt.distinct().withColumn("_g", F.col("px") - F.row_number().over(line.orderBy("px")))
    runs = numbered.groupBy(*by, "py", "_g").agg(F.min("px").alias("x0"), F.max("px").alias("x1"))

    def grow(table: pa.Table) -> pa.Table:
        line, first, last = (table.column(c).to_numpy().astype(np.int64) for c in ("py", "x0", "x1"))
        order = np.lexsort((first, line))
        found = _grown(line[order], first[order], last[order], radius)
        here = table.select(by).take(pa.array(np.zeros(len(found["py"]), np.int64)))
        return pa.table([*here.columns, *map(pa.array, found.values())], names=[*by, *found])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    return runs.groupBy(*by).applyInArrow(grow, f"{kinds}, {_RUN}")


def mask_cells(masks: DataFrame, radius: int, threshold: int = 127) -> DataFrame:
    """(image, category, px, py, component) out of masks as for ``mask_runs``: one row for each covered pixel."""
    runs = mask_runs(masks, radius, threshold)
    return runs.select("image", "category", F.explode(F.sequence("x0", "x1")).alias("px"), "py", "component")


def control_points(moves: DataFrame, width: float, height: float, seed: str) -> DataFrame:
    """``mx, my`` half way, and ``cx, cy``: the third corner of an equilateral triangle over a move.

    Of the two corners the one inside the image is taken; a coin decides when both are, and the
    one that is out by less when neither is (the first when both are out by as much, up to nine decimals).
    """
    half, root = 0.5, float(np.sqrt(3) / 2)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    corner = lambda s: (F.col("x0") + half * dx - s * root * dy, F.col("y0") + s * root * dx + half * dy)
    (ax, ay), (bx, by) = corner(1.0), corner(-1.0)
    out_a, out_b = (F.round(border_distance(x, y, F.lit(width), F.lit(height)), 9) for x, y in ((ax, ay), (bx, by)))
    coin = draw(seed, F.col("move_id")) % 2 == 0
    first = F.when((out_a < 0) & (out_b < 0), coin).otherwise(out_a <= out_b)
    return moves.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2, "cx": F.when(first, ax).otherwise(bx), "cy": F.when(first, ay).otherwise(by)})


def weighted_moments(cells: DataFrame, by: list[str], x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted mean, covariance, its inverse, and the square root of the product of the SDs along the axes."""
    s = F.sum(w)
    mean = cells.where(F.col(w) > 0).groupBy(*by).agg(s.alias("mass"), (F.sum(F.col(w) * F.col(x)) / s).alias("mx"), (F.sum(F.col(w) * F.col(y)) / s).alias("my"))
    met = cells.where(F.col(w) > 0).join(mean, by)
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    cov = met.groupBy(*by).agg(F.first("mass").alias("mass"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[(F.sum(F.col(w) * a * b) / F.first("mass")).alias(n) for n, a, b in (("cxx", dx, dx), ("cxy", dx, dy), ("cyy", dy, dy))])
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    return cov.withColumns({"ixx": F.try_divide(F.col("cyy"), det), "ixy": F.try_divide(-F.col("cxy"), det), "iyy": F.try_divide(F.col("cxx"), det), "radius": F.pow(F.greatest(det, F.lit(0.0)), F.lit(0.25))})


def crossed(*tables: DataFrame) -> DataFrame:
    """Every combination of the rows of small parameter tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))  # parameter tables, made by the caller
    return out


def gaussian(params: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """amplitude, x, y, a, b, angle, offset: an ellipse of SDs a and b turned by the angle."""
    amp, mx, my, a, b, turn, base = params
    c, s = np.cos(turn), np.sin(turn)
    u, v = (x - mx) * c + (y - my) * s, -(x - mx) * s + (y - my) * c
    return amp * np.exp(-0.5 * ((u / a) ** 2 + (v / b) ** 2)) + base


#: Cells that a stack of maps may have, padding included.
STACK_CELLS = 1 << 19
#: Maps are padded to a multiple of this many cells, so a map's sums don't depend on its neighbours.
PAD = 32
#: Variances up to this are taken as 0.
FLAT = 1e-8

STAGES = ("start", "fit")
PARAMETERS = ("amplitude", "x0", "y0", "a", "b", "angle", "offset")
STATISTICS = ("at_centre", "r", "weighted", "coverage")


def _bumps(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each map's ellipse of height 1 at its cells, and the derivatives of the scaled one by all seven parameters."""
    amp, mx, my, a, b, turn, _ = (c[:, None] for c in p.T)
    c, s, dx, dy = np.cos(turn), np.sin(turn), x - mx, y - my
    u, v = dx * c + dy * s, dy * c - dx * s
    ua, vb = u / (a * a), v / (b * b)
    bump = np.exp(-0.5 * (u * ua + v * vb))
    scaled = amp * bump
    return bump, np.stack([bump, scaled * (c * ua - s * vb), scaled * (s * ua + c * vb), scaled * u * ua / a, scaled * v * vb / b, scaled * (u * vb - v * ua), np.ones_like(bump)], 2)


def _moment_start(x: np.ndarray, y: np.ndarray, z: np.ndarray, there: np.ndarray, w: np.ndarray, amp: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The ellipses of the weighted moments, major axis first."""
    w = w / w.sum(1, keepdims=True)
    mx, my = (w * x).sum(1), (w * y).sum(1)
    dx, dy = np.where(there, x - mx[:, None], 0), np.where(there, y - my[:, None], 0)
    cov = np.stack([(w * dx * dx).sum(1), (w * dx * dy).sum(1), (w * dx * dy).sum(1), (w * dy * dy).sum(1)], 1).reshape(-1, 2, 2)
    values, vectors = np.linalg.eigh(cov + 1e-6 * np.eye(2))
    return np.stack([amp, mx, my, np.sqrt(values[:, 1]), np.sqrt(values[:, 0]), np.arctan2(vectors[:, 1, 1], vectors[:, 0, 1]), base], 1)


def _descend(p: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, there: np.ndarray, free: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Levenberg-Marquardt for all maps of a stack at once; each has its own damping and leaves when it is done."""
    p = p.copy()

    def error(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (np.where(there[at], q[:, :1] * _bumps(q, x[at], y[at])[0] + q[:, 6:] - z[at], 0) ** 2).sum(1)

    left = np.arange(len(p))
    damp, best = np.full(len(p), 1e-2), error(p, left)
    for _ in range(rounds):
        if not len(left):
            break
        q = p[left]
        bump, slopes = _bumps(q, x[left], y[left])
        slopes = np.where(there[left][:, :, None], slopes[:, :, free], 0)
        off = np.where(there[left], z[left] - q[:, :1] * bump - q[:, 6:], 0)
        turned = slopes.transpose(0, 2, 1)
        normal, toward = turned @ slopes, turned @ off[:, :, None]
        damped = normal + (damp[left][:, None] * (np.diagonal(normal, axis1=1, axis2=2) + 1e-12))[:, :, None] * np.eye(len(free))
        try:
            move = np.linalg.solve(damped, toward)[:, :, 0]
        except np.linalg.LinAlgError:  # one of them is singular
            move = (np.linalg.pinv(damped, hermitian=True) @ toward)[:, :, 0]
        q[:, free] += move
        q[:, 3:5] = np.maximum(np.abs(q[:, 3:5]), 1e-3)
        now = error(q, left)
        better = np.isfinite(now) & (now < best[left])
        done = better & (best[left] - now < 1e-12 * best[left])
        p[left[better]], best[left[better]] = q[better], now[better]
        damp[left] = np.where(better, np.maximum(damp[left] / 3, 1e-12), damp[left] * 4)
        left = left[~done & (damp[left] <= 1e8)]
    return p


def _statistics(p: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, there: np.ndarray, shape: np.ndarray, area: np.ndarray) -> np.ndarray:
    """By map: the value of the cell that holds the centre, the correlation of ellipse and ``shape``, the mean of
    positive values weighted by the ellipse (0 where that is 0), and the share of the ellipse that the cells cover."""
    bump = np.where(there, _bumps(p, x, y)[0], 0)
    column = np.where(there & (x <= p[:, 1:2]), x, -np.inf).max(1, keepdims=True)
    line = np.where(there & (y <= p[:, 2:3]), y, -np.inf).max(1, keepdims=True)
    holds = there & (x == column) & (y == line)
    centre = np.where(holds.any(1), np.where(holds, z, 0).sum(1), np.nan)
    n = there.sum(1)
    model = np.where(there, p[:, :1] * bump + p[:, 6:], 0)
    dm, dz = (np.where(there, v - (np.where(there, v, 0).sum(1) / n)[:, None], 0) for v in (model, shape))
    vm, vz = (dm * dm).sum(1), (dz * dz).sum(1)
    r = np.where((vm > n * FLAT) & (vz > n * FLAT), (dm * dz).sum(1) / np.sqrt(np.where(vm * vz > 0, vm * vz, 1)), np.nan)
    up = np.where(z > 0, bump, 0)
    mass = up.sum(1)
    mean = np.where(mass > 0, (up * np.where(there, z, 0)).sum(1) / np.where(mass > 0, mass, 1), 0)
    return np.stack([centre, np.clip(r, -1, 1), mean, bump.sum(1) * area / (2 * np.pi * p[:, 3] * p[:, 4])], 1)


def _step(v: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The smallest distance of two distinct coordinates, NaN where there is one only."""
    line = np.sort(np.where(there, v, np.inf), axis=1)
    last = there.sum(1)[:, None] - 1  # padding is at the end
    gaps = np.diff(np.where(np.arange(line.shape[1]) <= last, line, np.take_along_axis(line, last, 1)), axis=1)
    least = np.where(gaps > 0, gaps, np.inf).min(1, initial=np.inf)
    return np.where(np.isfinite(least), least, np.nan)


def _fit_stack(x: np.ndarray, y: np.ndarray, z: np.ndarray, there: np.ndarray, positive: bool) -> np.ndarray:
    """Parameters, top value and the statistics of both stages for a stack of padded maps, NaN for those that can't be fitted."""
    n = there.sum(1)
    top = np.where(there, z, -np.inf).max(1)
    if positive:
        shape = np.where(there & (z > 0), z, 0) / np.where(top > 0, top, 1)[:, None]
        w, amp, base, free = shape, np.ones(len(z)), np.zeros(len(z)), np.arange(1, 6)
        fits = (w > 0).sum(1) > 1
    else:
        base = np.nanmedian(np.where(there, z, np.nan), axis=1)
        shape, w, amp, free = z, np.where(there, np.maximum(z - base[:, None], 0), 0), top - base, np.arange(7)
        fits = (n >= 8) & (w.sum(1) > 0)
    out = np.full((len(z), len(PARAMETERS) + 1 + len(STAGES) * len(STATISTICS)), np.nan)
    at = np.flatnonzero(fits)
    if len(at):
        x, y, z, there, shape, w, amp, base = (v[at] for v in (x, y, z, there, shape, w, amp, base))
        area = _step(x, there) * _step(y, there)
        start = _moment_start(x, y, z, there, w, amp, base)
        p = _descend(start, x, y, shape, there, free)
        given = p.copy()
        given[:, 0] *= top[at] if positive else 1
        given[:, 5] %= 2 * np.pi
        out[at] = np.concatenate([given, top[at, None], *(_statistics(q, x, y, z, there, shape, area) for q in (start, p))], 1)
    return out


def fit_gaussians(maps: DataFrame, by: list[str], x: str = "x", y: str = "y", z: str = "z", positive: bool = False) -> DataFrame:
    """Per map: an ellipse from the moments, refined by least squares, and five statistics for each of the two stages.

    Returned are amplitude, x0, y0, a, b, angle, offset, the radius sqrt(a * b), ``top`` (the map's
    largest value, the same for both stages), and for the stages ``start`` and ``fit``: ``at_centre``
    (the value of the cell whose lower edges are the last ones up to the centre, NULL without one),
    ``r`` (NULL where a variance is about 0), ``weighted`` (the mean of positive values weighted by the
    ellipse) and ``coverage`` (the ellipse's integral over the cells, 1 when it lies within them).

    All seven parameters are fitted to the values, for maps of at least eight cells of which one is
    above the median.  With ``positive`` values below 0 count as 0 and the map is scaled to a top of 1,
    to which position, SDs and angle alone are fitted; such maps need two values above 0.  Other maps
    have NULLs.  Cells that are NULL or NaN are left out.

    A map is one row of three arrays; a task fits all maps of an Arrow batch in stacks of
    ``STACK_CELLS`` cells.
    """
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    numbers = {c: F.col(c).cast("double") for c in (x, y, z)}
    whole = F.lit(True)
    for v in numbers.values():
        whole = whole & v.isNotNull() & ~F.isnan(v)
    cell = F.when(whole, F.struct(*[v.alias(n) for n, v in zip(("x", "y", "z"), numbers.values(), strict=True)]))
    cells = spread_out(maps, *by).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    arrays = cells.select(*by, *[F.col(f"_cells.{n}").alias(f"_{n}") for n in ("x", "y", "z")])
    names = [*PARAMETERS, "top", *(f"{n}_{stage}" for stage in STAGES for n in STATISTICS)]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(f"_{n}") for n in ("x", "y", "z")]
            flat = [v.flatten().to_numpy(zero_copy_only=False) for v in lists]
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            found = np.full((len(sizes), len(names)), np.nan)
            padded = -(-sizes // PAD) * PAD
            for width in np.unique(padded[sizes > 0]):
                alike = np.flatnonzero((padded == width) & (sizes > 0))
                each = max(1, STACK_CELLS // int(width))
                for at in (alike[i : i + each] for i in range(0, len(alike), each)):
                    there = np.arange(width) < sizes[at, None]
                    take = np.where(there, first[at, None] + np.arange(width), first[at, None])
                    found[at] = _fit_stack(*(np.where(there, v[take], 0.0) for v in flat), there, positive)
            values = [pa.array(np.where(np.isfinite(c), c, 0.0), mask=~np.isfinite(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *values], names=[*by, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{n} double" for n in names)])
    return arrays.mapInArrow(fit, schema).withColumn("radius", F.sqrt(F.col("a") * F.col("b")))


def acceptable_fit(fits: DataFrame, least_amplitude: float = 0.04, least_r: float = 0.7, least_start: float = 0.5) -> DataFrame:
    finite = F.lit(True)
    for c in ("x0", "y0", "a", "b"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    return fits.where(finite & (F.col("amplitude") >= least_amplitude) & (F.col("r_fit") >= least_r) & (F.col("r_start") >= least_start)).withColumn("r", F.sqrt(F.col("a") * F.col("b")))


def map_consistency(fits: DataFrame, maps: DataFrame, by: list[str], split: str = "split") -> DataFrame:
    """(by, split_i, split_j, r, weighted): each split's ellipse against the map of every other split."""
    from tessella.functions.moments import pearson

    g = fits.select(*by, F.col(split).alias("split_i"), *[F.col(c).alias(f"g_{c}") for c in ("amplitude", "x0", "y0", "a", "b", "angle", "offset")])
    m = maps.select(*by, F.col(split).alias("split_j"), "x", "y", "z")
    met = g.join(m, by).where("split_i <> split_j")
    c, s = F.cos("g_angle"), F.sin("g_angle")
    dx, dy = F.col("x") - F.col("g_x0"), F.col("y") - F.col("g_y0")
    u, v = (dx * c + dy * s) / F.col("g_a"), (-dx * s + dy * c) / F.col("g_b")
    bump = F.exp(-0.5 * (u * u + v * v))
    met = met.withColumn("bump", bump).withColumn("model", F.col("g_amplitude") * F.col("bump") + F.col("g_offset"))
    return met.groupBy(*by, "split_i", "split_j").agg(pearson(F.col("model"), F.col("z")).alias("r"), F.try_divide(F.sum(F.col("bump") * F.col("z")), F.sum("bump")).alias("weighted"))


def distances_to_control(moves: DataFrame) -> DataFrame:
    """Distances of a control point from both ends of its move."""
    return moves.withColumn("d0", distance(F.col("x0"), F.col("y0"), F.col("cx"), F.col("cy"))).withColumn("d1", distance(F.col("x1"), F.col("y1"), F.col("cx"), F.col("cy")))
