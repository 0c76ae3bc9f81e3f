"""Cross-validated ridge fits of many units at once, and a permutation test of whether one response fits better than another.

Units are rows, not columns; products of features and responses are added up over chunks of samples, whose features pass
through a task in slices.  In the test features stay as they are in every replicate, so a place's and fold's normal equations are
factorised once for all replicates and units, and a replicate permutes responses by a
keyed bijection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import draws
from tessella.operators.ranking import global_rank, rank_within
from tessella.scratch import materialize

#: Samples of a chunk, responses of a unit, and units that one task holds at once.
SAMPLES, RESPONSES, UNITS = 1 << 17, 1 << 24, 16
#: Chunks over which the samples are dealt at least, responses of a row.
CHUNKS, SEGMENT = 8, 1 << 16
#: Tasks over which the replicates of a place and unit are dealt once their sums are there.
PARTS = 8
#: Numbers of a block of replicates, samples and units.
AT_ONCE = 1 << 21
#: Rows of samples and their features that are multiplied at once.
ROWS = 1 << 15
#: Variances up to it count as none.
LEAST_VARIANCE = 1e-8


def _add_products(out: np.ndarray, x: list[np.ndarray], folds: list[np.ndarray], y: np.ndarray, k: np.ndarray, start: int, n: int, replicates: np.ndarray, keys: np.ndarray) -> None:
    """Adds, by place, unit and replicate, for both conditions and every fold: sums of the features times y, of y, and of its square.

    ``k`` numbers some samples, in which order each place has features (with a column of ones) and folds; ``y``
    has the responses of each unit from ``start`` and a last column of 0 for those that another piece has.
    """
    units, size, width = len(y), y.shape[1] - 1, x[0].shape[1]
    alike: dict[bytes, list[int]] = {}  # places that deal the samples to the same folds are multiplied at once
    for p, fold in enumerate(folds):
        alike.setdefault(np.ascontiguousarray(fold).tobytes(), []).append(p)
    held = []
    for places in alike.values():
        for f in np.unique(folds[places[0]]):
            rows = np.flatnonzero(folds[places[0]] == f)
            held.append((places, f, rows, np.concatenate([x[p][rows] for p in places], 1)))
    step = max(1, AT_ONCE // max(1, len(k) * units))
    for lo in range(0, len(replicates), step):
        some = slice(lo, lo + step)
        for cond in (0, 1):
            at = draws.places(keys[some], 2 * n, at=cond * n + k).astype(np.int64)
            at[replicates[some] < 0] = cond * n + k
            at -= start
            drawn = y[:, np.where((at >= 0) & (at < size), at, size)]  # unit, replicate, sample
            for places, f, rows, features in held:
                part = drawn[:, :, rows]
                found = (part.reshape(-1, len(rows)) @ features).reshape(*part.shape[:2], len(places), width)
                squares = np.einsum("urs,urs->ur", part, part)
                for i, p in enumerate(places):
                    out[p, :, some, cond, f, :-1] += found[:, :, i]
                    out[p, :, some, cond, f, -1] += squares


def _scores(sums: np.ndarray, grams: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From ``sums`` (replicate, condition, fold, products) the correlations of held-out predictions, of each fold and pooled, and R squared."""
    d = grams.shape[1] - 1
    moments = []
    for f, gram in enumerate(grams):
        train, seen = grams.sum(0) - gram, sums.sum(2) - sums[:, :, f]
        n, sx, xx = train[0, 0], train[0, 1:], train[1:, 1:]
        centred = seen[..., :d] - seen[..., d, None] * sx / n
        w = np.linalg.solve(xx - np.outer(sx, sx) / n + alpha * np.eye(d), centred.reshape(-1, d).T).T.reshape(centred.shape)
        b = seen[..., d] / n - w @ sx / n
        m, sx, xx = gram[0, 0], gram[0, 1:], gram[1:, 1:]
        p, xy, sy, yy = w @ sx, sums[:, :, f, :d], sums[:, :, f, d], sums[:, :, f, d + 1]
        moments.append(np.stack([np.full(p.shape, m), p + m * b, sy, ((w @ xx) * w).sum(-1) + 2 * b * p + m * b * b, yy, (w * xy).sum(-1) + b * sy]))

    def corr(n, sp, sy, pp, yy, py):
        with np.errstate(invalid="ignore", divide="ignore"):
            vp, vy = pp / n - (sp / n) ** 2, yy / n - (sy / n) ** 2
            r = np.clip((py / n - sp * sy / n**2) / np.sqrt(vp * vy), -1, 1)
        return np.where((n >= 2) & (vp > LEAST_VARIANCE) & (vy > LEAST_VARIANCE), r, np.nan)

    n, sp, sy, pp, yy, py = sum(moments)
    with np.errstate(invalid="ignore", divide="ignore"):
        vy = yy / n - (sy / n) ** 2
        r2 = np.where(vy > 1e-13 * yy / n, 1 - (yy - 2 * py + pp) / (vy * n), np.nan)  # up to rounding
    return np.stack([corr(*m) for m in moments], -1), corr(n, sp, sy, pp, yy, py), r2


def _added(at: np.ndarray, lists: pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists of one length added up to the row that ``at`` says, of ``n`` rows."""
    flat = lists.combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    out = np.zeros((n, flat.shape[1]))
    np.add.at(out, at, flat)
    return out


def _fixed(x: np.ndarray) -> pa.ListArray:
    """Rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x[0].size if len(x) else np.zeros(1, np.int32)), pa.array(x.ravel()))


def fit_difference_test(features: DataFrame, responses: DataFrame, alpha: float, n_perm: int, seed: str, reference: object = None, alternative: str = "two-sided") -> DataFrame:
    """(place, unit, corr0, corr1, p): fits of two responses at every place, and the p-value of their difference.

    ``features`` has place, key, fold (from 0) and x, an array; ``responses`` has key, unit, y0 and y1.  Ridge
    fits are cross-validated by fold; ``corr0`` and ``corr1`` are of all held-out predictions, the test compares
    those of each fold and pools the folds.  A replicate permutes all responses of both
    conditions together and splits them in halves of the samples' number; places and units share it.  With a
    ``reference`` place the differences less those there are tested, and its own p is NULL.
    "greater" asks whether y0 fits better, "less" whether y1 does.  Samples that lack a response of some unit or features at some
    place are left out everywhere.  Every fold has to leave two samples for the fit.
    """
    n_units, n_places = responses.select("unit").distinct().count(), features.select("place").distinct().count()
    whole = responses.where("y0 IS NOT NULL AND y1 IS NOT NULL AND NOT isnan(y0) AND NOT isnan(y1)").groupBy("key").agg(F.count("*").alias("_u")).where(F.col("_u") == n_units)
    seen = features.where("x IS NOT NULL").groupBy("key").agg(F.count("*").alias("_p")).where(F.col("_p") == n_places)
    samples = materialize(global_rank(whole.join(seen, "key").select("key"), ["key"], "_k").withColumn("_k", F.col("_k") - 1), "samples")
    n = samples.count()
    there = features.where("x IS NOT NULL")
    n_folds = (there.agg(F.max("fold")).first()[0] or 0) + 1
    n_pieces, n_blocks, n_chunks = max(1, -(-2 * n // RESPONSES)), max(1, -(-n_units // UNITS)), max(CHUNKS, -(-n // SAMPLES))
    segment = min(SEGMENT, RESPONSES)
    # features are shuffled once, to the chunk of their key; what a chunk's samples draw comes to it as numbers
    chunk = F.pmod(F.xxhash64("key"), F.lit(n_chunks)).cast("int").alias("chunk")
    meet = F.explode(F.sequence(F.lit(0), F.lit(n_pieces * n_blocks - 1))).alias("_m")
    chunks = there.where("key IS NOT NULL").select("place", "key", "fold", "x", chunk, meet)
    each = responses.join(samples, "key").select("unit", F.posexplode(F.array(F.col("y0").cast("double"), F.col("y1").cast("double"))).alias("_c", "_y"), "_k").withColumn("_at", (F.col("_c") * n + F.col("_k")).cast("long"))
    piece, row = F.expr(f"_at div {RESPONSES}"), F.expr(f"_at % {RESPONSES} div {segment}")
    series = each.groupBy("unit", piece.alias("piece"), row.alias("row")).agg(F.array_sort(F.collect_list(F.struct("_at", "_y"))).alias("_h"))
    numbered = materialize(global_rank(responses.select("unit").distinct(), ["unit"], "_r"), "units")
    dealt = series.join(numbered, "unit").select("unit", F.col("_h._at")[0].alias("_at"), F.col("_h._y").alias("y"), (F.expr(f"(_r - 1) div {UNITS}") * n_pieces + F.col("piece")).cast("int").alias("_m"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    met = samples.select(chunk, meet, "key", "_k").unionByName(dealt, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
    # a task for each chunk and block: its responses first, then each sample with its features
    met = met.repartitionById(n_chunks * n_pieces * n_blocks, (F.col("chunk") * (n_pieces * n_blocks) + F.col("_m")).cast("int")).sortWithinPartitions(F.col("y").isNull(), "key", F.col("_k").isNull())
    kinds = {c: df.schema[c].dataType for c, df in (("place", features), ("unit", responses))}

    def samples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole samples with their features, some ``ROWS`` rows at once."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                codes = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
                last = int(np.argmax(codes == codes[-1]))  # the last sample may go on
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicates = np.arange(-1, n_perm)
        keys = draws.bijection_keys(seed, replicates)
        first, given = None, []

        def rest() -> Iterator[pa.RecordBatch]:  # leaves the responses in ``given`` on its way
            nonlocal first
            for batch in batches:
                if batch.num_rows and first is None:
                    first = batch.column("_m")[0].as_py()
                mine = batch.filter(pc.is_valid(batch.column("y")))
                given.extend(zip(mine.column("unit").to_pylist(), mine.column("_at").to_pylist(), mine.column("y"), strict=True))
                if mine.num_rows < batch.num_rows:
                    yield batch.filter(pc.is_null(batch.column("y"))).select(["key", "_k", "place", "fold", "x"])

        y = out = None
        seen_at: list = []
        units: dict = {}
        for table in samples_of(rest()):
            if y is None:  # sorted, so all responses have come
                units = {u: i for i, u in enumerate(dict.fromkeys(u for u, _, _ in given))}
                start = first % n_pieces * RESPONSES
                y = np.zeros((len(units), min(RESPONSES, 2 * n - start) + 1))
                for u, at, values in given:
                    y[units[u], at - start : at - start + len(values)] = values.values.to_numpy()
                given.clear()
            mine, features = table.filter(pc.is_valid(table.column("_k"))), table.filter(pc.is_null(table.column("_k")))
            features = features.append_column("_of", pc.index_in(features.column("key"), mine.column("key").combine_chunks()))
            features = features.filter(pc.is_valid(features.column("_of")))
            if not features.num_rows or not units:
                continue
            places = features.column("place").combine_chunks().dictionary_encode()
            flat = features.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(features.num_rows, -1)
            of, fold, k = (t.column(c).to_numpy() for t, c in ((features, "_of"), (features, "fold"), (mine, "_k")))
            x, folds = [], []
            seen_at = seen_at or places.dictionary.to_pylist()  # every place has all samples
            for code in map(places.dictionary.to_pylist().index, seen_at):
                rows = np.flatnonzero(places.indices.to_numpy() == code)
                rows = rows[np.argsort(of[rows])]
                x.append(np.concatenate([flat[rows].astype(np.float64), np.ones((len(rows), 1))], 1))
                folds.append(fold[rows])
            if out is None:
                width = x[0].shape[1]
                out, grams = np.zeros((len(x), len(units), len(replicates), 2, n_folds, width + 1)), np.zeros((len(x), n_folds, width, width))
            _add_products(out, x, folds, y, k, start, n, replicates, keys)
            if first == 0:  # the sums of the features are the same for all
                for p, (v, own) in enumerate(zip(x, folds, strict=True)):
                    z = np.concatenate([v[:, -1:], v[:, :-1]], 1)
                    for f in np.unique(own):
                        grams[p, f] += z[own == f].T @ z[own == f]
        if out is None:
            return
        for p, u in np.ndindex(out.shape[:2]):
            yield pa.RecordBatch.from_arrays([pa.array([seen_at[p]] * len(replicates), place_kind), pa.array([list(units)[u]] * len(replicates), unit_kind), pa.array(replicates), _fixed(out[p, u].reshape(len(replicates), -1))], names=["place", "unit", "b", "sums"])
        if first == 0:
            of_fold = np.tile(-2 - np.arange(n_folds), len(seen_at))
            yield pa.RecordBatch.from_arrays([pa.array([p for p in seen_at for _ in range(n_folds)], place_kind), pa.nulls(len(of_fold), unit_kind), pa.array(of_fold), _fixed(grams.reshape(len(of_fold), -1))], names=["place", "unit", "b", "sums"])

    place_kind, unit_kind = (to_arrow_type(t) for t in kinds.values())
    names = {c: t.simpleString() for c, t in kinds.items()}
    multiplied = met.mapInArrow(multiply, f"place {names['place']}, unit {names['unit']}, b long, sums array<double>")
    sums = materialize(multiplied, "products")
    grams = sums.where("b < -1").select(F.col("place").alias("of_place"), (-2 - F.col("b")).alias("fold"), F.col("sums").alias("grams"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of_part")
    everywhere = grams.crossJoin(numbered.select(F.col("unit").alias("of_unit"), parts))  # a row for each place, fold, chunk, unit and part
    products = sums.where("b >= -1").withColumn("_part", F.pmod("b", F.lit(PARTS)).cast("int"))

    def solve(key: tuple, products: pa.Table, grams: pa.Table) -> pa.Table:
        replicates, at = np.unique(products.column("b").to_numpy(), return_inverse=True)
        total = _added(at, products.column("sums"), len(replicates))
        held = _added(grams.column("fold").to_numpy(), grams.column("grams"), n_folds)
        size = int(held.shape[1] ** 0.5)
        each, pooled, _r2 = _scores(total.reshape(len(replicates), 2, n_folds, -1), held.reshape(n_folds, size, size), alpha)
        names = ["place", "unit", "b", "corr0", "corr1", "d"]
        take = pa.array(np.zeros(len(replicates), np.int64))
        gaps = each[:, 1] - each[:, 0]
        return pa.table([products.column("place").combine_chunks().take(take), products.column("unit").combine_chunks().take(take), pa.array(replicates), pa.array(pooled[:, 0]), pa.array(pooled[:, 1]), _fixed(gaps)], names=names)

    schema = f"place {names['place']}, unit {names['unit']}, b long, corr0 double, corr1 double, d array<double>"
    fits = materialize(products.groupBy("place", "unit", "_part").cogroup(everywhere.groupBy("of_place", "of_unit", "of_part")).applyInArrow(solve, schema), "fits")
    seen = fits.where("b < 0").select("place", "unit", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("corr0", "corr1")])
    gaps = fits.select("place", "unit", "b", F.posexplode("d").alias("fold", "d"))
    if reference is not None:
        there = gaps.where(F.col("place") == F.lit(reference)).select("unit", "b", "fold", F.col("d").alias("_d"))
        gaps = gaps.join(there, ["unit", "b", "fold"]).withColumn("d", F.col("d") - F.col("_d"))
    observed = gaps.where("b < 0").select("place", "unit", "fold", F.col("d").alias("_o"))
    met = gaps.where("b >= 0").join(observed, ["place", "unit", "fold"])
    beyond = {"two-sided": F.abs("_o") - F.abs("d"), "less": F.col("_o") - F.col("d"), "greater": F.col("d") - F.col("_o")}[alternative]
    ok = ~F.isnan(beyond)
    count = F.count_if(ok)
    p = F.greatest(F.lit(1.0) - F.count_if(ok & (beyond > 0)) / count, F.lit(1.0) / (count + 1))
    tested = met.groupBy("place", "unit").agg(F.when(count > 0, p).alias("p"))
    if reference is not None:
        tested = tested.where(F.col("place") != F.lit(reference))
    return seen.join(tested, ["place", "unit"], "left").select("place", "unit", "corr0", "corr1", "p")


def fit_by_field(features: DataFrame, responses: DataFrame, alpha: float) -> DataFrame:
    """(field, unit, n, corr, r2): cross-validated ridge fits of every unit to what lies in its own field.

    ``features`` has field, key, fold (from 0) and x, an array, for each distinct field; ``responses`` has
    field, unit, key and y, a row for each unit and sample.  Units that share a field share its
    normal equations.  Samples that lack a response of some unit of the field are left out for the
    field; correlation and R squared of the pooled held-out predictions are NULL without variance.
    """
    given = responses.where("y IS NOT NULL AND NOT isnan(y)").select("field", "unit", "key", F.col("y").cast("double").alias("y"))
    units = responses.select("field", "unit").distinct()
    named = materialize(rank_within(units, ["field"], ["unit"], "_r").select("field", "unit", "_r", F.expr(f"(_r - 1) div {UNITS}").alias("_block")), "field-units")
    n_units = named.groupBy("field").agg(F.count("*").alias("_n"))
    # numbers alone are gathered: a sample's responses, block by block; features are read once and meet them once
    each = given.join(named, ["field", "unit"]).groupBy("field", "key", "_block").agg(F.array_sort(F.collect_list(F.struct("_r", "y"))).alias("_h"))
    blocks = each.select("field", "key", "_block", F.col("_h.y").alias("y"))
    whole = blocks.groupBy("field", "key").agg(F.sum(F.size("y")).alias("_u"), F.collect_list(F.struct("_block", "y")).alias("_b"))
    whole = whole.join(n_units, "field").where("_u = _n").select("field", "key", "_b")
    n_folds = (features.where("x IS NOT NULL").agg(F.max("fold")).first()[0] or 0) + 1
    met = features.where("x IS NOT NULL").select("field", "key", "fold", "x").join(whole, ["field", "key"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            x = np.concatenate([np.ones((len(fold), 1)), batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fold), -1)], 1)
            lists, place = batch.column("_b"), batch.column("field").dictionary_encode()
            at = np.repeat(np.arange(len(fold)), lists.value_lengths().to_numpy())
            block, y = lists.flatten().field("_block").to_numpy(), lists.flatten().field("y")
            first, size, flat = np.cumsum(y.value_lengths().to_numpy()) - y.value_lengths().to_numpy(), y.value_lengths().to_numpy(), y.flatten().to_numpy()
            codes = place.indices.to_numpy()
            for code, f in set(zip(codes.tolist(), fold.tolist(), strict=True)):
                own = (codes == code) & (fold == f)
                name = place.dictionary[code].as_py()
                put(held, (name, f, -1), x[own].T @ x[own])
                for k in np.unique(block[own[at]]):
                    rows = np.flatnonzero(own[at] & (block == k))
                    z = flat[first[rows][:, None] + np.arange(size[rows[0]])]
                    put(held, (name, f, k), np.concatenate([z.T @ x[at[rows]][:, 1:], z.sum(0)[:, None], (z * z).sum(0)[:, None]], 1))
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], names=["field", "fold", "_block", "sums"])

    def put(held: dict[tuple, np.ndarray], key: tuple, sums: np.ndarray) -> None:
        held[key] = held[key] + sums if key in held else sums

    kind = to_arrow_type(responses.schema["field"].dataType)
    kinds = {c: responses.schema[c].dataType.simpleString() for c in ("field", "unit")}
    parts = materialize(met.mapInArrow(add, f"field {kinds['field']}, fold int, _block long, sums array<double>"), "field-sums")  # of each task a row for each field, fold and block
    blocked = named.groupBy("field", "_block").agg(F.array_sort(F.collect_list(F.struct("_r", "unit"))).alias("_h")).select("field", "_block", F.col("_h.unit").alias("units"))
    dealt = parts.where("_block >= 0").join(blocked, ["field", "_block"])
    grams = parts.where("_block < 0").select(F.col("field").alias("of_field"), F.col("fold").alias("of_fold"), F.col("sums").alias("grams"))
    grams = grams.join(blocked.select(F.col("field").alias("of_field"), F.col("_block").alias("of_block")), "of_field")

    def solve(key: tuple, products: pa.Table, grams: pa.Table) -> pa.Table:
        units = products.column("units").combine_chunks()[0].values
        size = int(len(grams.column("grams")[0]) ** 0.5)
        held = _added(grams.column("of_fold").to_numpy(), grams.column("grams"), n_folds).reshape(n_folds, size, size)
        total = _added(products.column("fold").to_numpy(), products.column("sums"), n_folds).reshape(n_folds, len(units), size + 1).transpose(1, 0, 2)
        _each, corr, r2 = _scores(total[:, None], held, alpha)
        field = products.column("field").combine_chunks().take(pa.array(np.zeros(len(total), np.int64)))
        n = np.full(len(total), int(held[:, 0, 0].sum()))
        return pa.table([field, units, pa.array(n), pa.array(corr[:, 0]), pa.array(r2[:, 0])], names=["field", "unit", "n", "corr", "r2"])

    scored = dealt.groupBy("field", "_block").cogroup(grams.groupBy("of_field", "of_block")).applyInArrow(solve, f"field {kinds['field']}, unit {kinds['unit']}, n long, corr double, r2 double")
    return scored.select("field", "unit", "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("corr", "r2")])
