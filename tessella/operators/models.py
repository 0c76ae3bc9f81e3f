"""Cross-validated ridge regression over feature arrays, with sweeps over places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.moments import pearson, r_squared
from tessella.functions.scalars import draw
from tessella.operators.ranking import global_rank


def alias_map(lines: DataFrame) -> DataFrame:
    """(alias, canonical) out of lines of tab-separated names whose first is canonical; an alias of several lines has the smallest."""
    names = F.split("value", "\t")
    found = lines.select(names[0].alias("canonical"), F.explode(names).alias("alias")).where("alias <> ''")
    return found.groupBy("alias").agg(F.min("canonical").alias("canonical"))


def canonical_groups(rows: DataFrame, aliases: DataFrame, group: str) -> DataFrame:
    """``group`` replaced by its canonical name where it has one."""
    a = aliases.select(F.col("alias").alias(group), F.col("canonical").alias("_c"))
    return rows.join(a, group, "left").withColumn(group, F.coalesce("_c", group)).drop("_c")


def snake_folds(rows: DataFrame, group: str, n_splits: int) -> DataFrame:
    """``fold`` for each row: groups by falling size dealt 0..k-1, k-1..0 and so on; no group spans folds."""
    sizes = global_rank(rows.groupBy(group).agg(F.count("*").alias("_n")), [F.col("_n").desc(), F.col(group)], "_k")
    k = F.col("_k") - 1
    place = (k % (2 * n_splits)).cast("int")
    fold = F.when(place < n_splits, place).otherwise(2 * n_splits - 1 - place)
    return rows.join(sizes.withColumn("fold", fold).drop("_n", "_k"), group)


def greedy_runs(sizes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, list[int], list[list[int]]]]:
    """(n, groups before, starts, cycles) for each (n, how many groups have n rows), largest first.

    Greedy dealing of equal groups goes through levels of n rows: a fold takes part from the level of its
    load on, so from each of ``starts`` on a cycle of folds repeats.
    """
    loads, before, out = [0] * n_splits, 0, []
    for n, groups in sizes:
        low = min(loads)
        level = [(load - low) // n for load in loads]
        turn = sorted(range(n_splits), key=lambda i: ((loads[i] - low) % n, i))
        steps = sorted(set(level))
        starts, cycles, at = [], [], 0
        for k, step in enumerate(steps):
            if at >= groups:
                break
            cycle = [i for i in turn if level[i] <= step]
            most = groups - at if k + 1 == len(steps) else min(groups - at, (steps[k + 1] - step) * len(cycle))
            starts.append(at)
            cycles.append(cycle)
            for place, i in enumerate(cycle):
                loads[i] += n * ((most - place + len(cycle) - 1) // len(cycle))
            at += most
        out.append((n, before, starts, cycles))
        before += groups
    return out


def greedy_folds(rows: DataFrame, group: str, n_splits: int, seed: str) -> DataFrame:
    """``fold`` for each row: groups by falling size, equal ones in a seeded order, each to the fold with the fewest rows.

    The driver sees a row for each size that occurs, not for each group.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    counted = sorted(((r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True)
    runs = rows.sparkSession.createDataFrame(greedy_runs(counted, n_splits), "n long, _before long, _starts array<long>, _cycles array<array<int>>")
    ranked = global_rank(sizes, [F.col("n").desc(), draw(seed, F.col(group)), F.col(group)], "_k")
    at = F.col("_k") - 1 - F.col("_before")
    run = F.size(F.filter("_starts", lambda s: s <= at))
    cycle = F.element_at("_cycles", run)
    fold = F.get(cycle, ((at - F.element_at("_starts", run)) % F.size(cycle)).cast("int"))
    return rows.join(ranked.join(F.broadcast(runs), "n").select(group, fold.alias("fold")), group)  # sizes that occur: at most the root of twice the rows


def shuffled_folds(rows: DataFrame, key: str, n_splits: int, seed: str) -> DataFrame:
    """``fold`` by a seeded draw of each row, without regard to groups."""
    return rows.withColumn("fold", (draw(seed, F.col(key)) % n_splits).cast("int"))


def fold_grams(rows: DataFrame, by: list[str], x: str, ys: list[str]) -> DataFrame:
    """(by, fold, gram, size) of one pass over the rows: sums of the products of 1, X and Y of each group and fold.

    Only these sums are shuffled; their size depends on the number of features, targets, groups
    and folds, not of rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby([*by, "fold"], sort=False):
                z = np.concatenate([np.ones((len(part), 1)), np.stack(part[x].to_numpy()).astype(np.float64), part[ys].to_numpy(np.float64)], 1)
                held[key] = held.get(key, 0) + z.T @ z
        for key, gram in held.items():
            yield pd.DataFrame([[*key, gram.ravel(), len(gram)]], columns=[*by, "fold", "gram", "size"])

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[: len(by) + 1], np.sum(np.stack(frame["gram"].to_numpy()), 0), int(frame["size"].iloc[0])]], columns=[*by, "fold", "gram", "size"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "fold int", "gram array<double>", "size int"])
    parts = rows.select(*by, "fold", x, *ys).mapInPandas(partial, schema).withColumn("_p", F.spark_partition_id() % 32)
    once = parts.groupBy(*by, "fold", "_p").applyInPandas(add, schema)
    return once.groupBy(*by, "fold").applyInPandas(add, schema)


def fold_sums(rows: DataFrame, by: list[str], x: str, ys: list[str]) -> dict[tuple, dict[int, np.ndarray]]:
    """{key: {fold: sums}} of ``fold_grams`` on the driver; meant for few groups."""
    out: dict[tuple, dict[int, np.ndarray]] = {}
    for row in fold_grams(rows, by, x, ys).collect():
        g = np.array(row["gram"]).reshape(row["size"], row["size"])
        out.setdefault(tuple(row[c] for c in by), {})[row["fold"]] = g
    return out


def solve(gram: np.ndarray, n_targets: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of ridge regression on centred data, from the sums of 1, X and Y."""
    d = len(gram) - 1 - n_targets
    n, sx, sy = gram[0, 0], gram[0, 1 : d + 1], gram[0, d + 1 :]
    xx = gram[1 : d + 1, 1 : d + 1] - np.outer(sx, sx) / n
    xy = gram[1 : d + 1, d + 1 :] - np.outer(sx, sy) / n
    w = np.linalg.solve(xx + alpha * np.eye(d), xy)
    return w, sy / n - (sx / n) @ w


def fit_folds(rows: DataFrame, by: list[str], x: str, ys: list[str], alpha: float) -> dict[tuple, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """{key: {fold: (weights, intercepts)}}, each fitted without its fold: all sums minus the fold's."""
    out: dict[tuple, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for key, folds in fold_sums(rows, by, x, ys).items():
        total = sum(folds.values())
        out[key] = {f: solve(total - g, len(ys), alpha) for f, g in folds.items() if total[0, 0] - g[0, 0] >= 2}
    return out


def predict_folds(rows: DataFrame, by: list[str], x: str, ys: list[str], fits: dict) -> DataFrame:
    """(by, fold, unit, y, pred): held-out predictions of every target, one row each."""
    model = rows.sparkSession.sparkContext.broadcast(fits)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby([*by, "fold"], sort=False):
                found = model.value.get(tuple(key[:-1]), {}).get(int(key[-1]))
                if found is None:
                    continue
                pred = np.stack(part[x].to_numpy()).astype(np.float64) @ found[0] + found[1]
                for i, y in enumerate(ys):
                    yield pd.DataFrame({**{c: part[c] for c in by}, "fold": part["fold"], "unit": y, "y": part[y].astype(float), "pred": pred[:, i]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "fold int", "unit string", "y double", "pred double"])
    return rows.select(*by, "fold", x, *ys).mapInPandas(predict, schema)


def evaluate(predictions: DataFrame, by: list[str], per_split: bool = False) -> DataFrame:
    """Correlation (NULL without variance, up to rounding) and R squared of the pooled held-out predictions, or of each fold's."""
    keys = [*by, "unit", *(["fold"] if per_split else [])]
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("pred"), F.col("y"), 1e-8).alias("corr"), r_squared(F.col("y"), F.col("pred")).alias("r2"))


def cv_ridge(rows: DataFrame, by: list[str], x: str, ys: list[str], alpha: float) -> DataFrame:
    """Held-out predictions of one fit for each group and fold (``rows`` has ``fold``)."""
    return predict_folds(rows, by, x, ys, fit_folds(rows, by, x, ys, alpha))


def cv_ridge_scores(rows: DataFrame, by: list[str], x: str, ys: list[str], alpha: float, per_split: bool = False, least_variance: float = 1e-8) -> DataFrame:
    """``evaluate(cv_ridge(...))`` out of the sums alone: each group is fitted and scored where its sums are.

    A held-out prediction is linear in the features, so its moments and products with the response follow
    from the fold's sums; rows are read once and nothing reaches the driver.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        grams = {int(f): np.array(g).reshape(n, n) for f, g, n in zip(frame["fold"], frame["gram"], frame["size"], strict=True)}
        total, moments = sum(grams.values()), {}
        for fold, g in grams.items():
            if total[0, 0] - g[0, 0] < 2:
                continue
            w, b = solve(total - g, len(ys), alpha)
            d, n = len(w), g[0, 0]
            sx, sy, xx, xy = g[0, 1 : d + 1], g[0, d + 1 :], g[1 : d + 1, 1 : d + 1], g[1 : d + 1, d + 1 :]
            p, centre = sx @ w, np.full(len(ys), n)
            moments[fold] = np.stack([centre, p + n * b, sy, ((xx @ w) * w).sum(0) + 2 * b * p + n * b * b, np.diag(g)[d + 1 :], (w * xy).sum(0) + b * sy])
        if moments and not per_split:
            moments = {0: sum(moments.values())}
        out = []
        for fold, (n, sp, sy, pp, yy, py) in moments.items():
            with np.errstate(invalid="ignore", divide="ignore"):
                vp, vy = pp / n - (sp / n) ** 2, yy / n - (sy / n) ** 2
                corr = np.clip((py / n - sp * sy / n**2) / np.sqrt(vp * vy), -1, 1)
                r2 = 1 - (yy - 2 * py + pp) / (vy * n)
            fine, varies = (n >= 2) & (vp > least_variance) & (vy > least_variance), vy > 1e-13 * np.abs(yy / n)  # up to rounding
            for i, unit in enumerate(ys):
                out.append([*frame[by].iloc[0], unit, *([fold] if per_split else []), int(n[i]), corr[i] if fine[i] else None, r2[i] if varies[i] else None])
        made = pd.DataFrame(out, columns=[*by, "unit", *(["fold"] if per_split else []), "n", "corr", "r2"])
        return made.astype({"corr": "Float64", "r2": "Float64"})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "unit string", *(["fold int"] if per_split else []), "n long", "corr double", "r2 double"])
    return fold_grams(rows, by, x, ys).groupBy(*by).applyInPandas(score, schema)


def feature_projection(rows: DataFrame, fits: dict[tuple, dict[int, tuple[np.ndarray, np.ndarray]]], peaks: dict[str, tuple], by: list[str], x: str, ys: list[str]) -> DataFrame:
    """(by, unit, fold, r): how features everywhere, projected on the weights of the unit's best place, follow held-out responses.

    ``peaks`` maps a unit to the key of ``fits`` at which it is predicted best.  Weights have unit length.
    """
    spark = rows.sparkSession
    weights = []
    for i, unit in enumerate(ys):
        for fold, (w, _) in fits.get(peaks.get(unit, ()), {}).items():
            size = np.linalg.norm(w[:, i])
            if size > 0:
                weights.append((unit, int(fold), (w[:, i] / size).tolist()))
    table = spark.createDataFrame(weights, "unit string, fold int, w array<double>")
    stack = ", ".join(f"'{y}', double({y})" for y in ys)
    long = rows.select(*by, "fold", x, F.expr(f"stack({len(ys)}, {stack}) as (unit, y)"))
    met = long.join(F.broadcast(table), ["unit", "fold"])  # units times folds rows
    dot = F.aggregate(F.zip_with(x, "w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return met.withColumn("p", dot).groupBy(*by, "unit", "fold").agg(pearson(F.col("p"), F.col("y"), 1e-8).alias("r"))


def pooled_folds(maps: DataFrame, by: list[str], n_folds: int) -> DataFrame:
    """The mean over folds where every fold has a finite value, else NULL."""
    ok = F.count_if(F.col("r").isNotNull() & ~F.isnan("r")) == n_folds
    return maps.groupBy(*by).agg(F.when(ok, F.avg("r")).alias("r"))


def embed(images: DataFrame, model, batch: int = 32, key: str = "image", pixels: str = "pixels") -> DataFrame:
    """(key, feat): features of images by a function of a list of byte strings, batch by batch in Arrow workers."""
    kind = images.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame({key: part[key], "feat": [np.asarray(v, np.float32) for v in model(list(part[pixels]))]})

    return images.select(key, pixels).mapInPandas(run, f"{key} {kind}, feat array<float>")
