"""Normalisation with copy states and latent factors, for cells or for clones, and the choice of K.

Depth is held packed per cell and per bin; g (bins x K) and h (cells x K) are small and go to the tasks as
they are. Only they, scalars and the bin bias come back to the driver.
"""

from __future__ import annotations

from base64 import b64decode, b64encode

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import poisson
from ..functions.numeric import low_quantile, signif
from ..functions.tables import passing, stored
from . import em, firstpass, qc

MOST_ROUNDS, MOST_INNER = 10, 50
FACTOR_CHANGE, SETTLED_FROM, AMONG = 1e-5, 10, 3
G_LIMIT, G_TAIL = 30.0, 0.005
#: Of the randomised iteration: vectors beside the k wanted, passes at most, relative size of what may be left.
SPARE_VECTORS, MOST_PASSES, SETTLED_VECTORS = 8, 40, 1e-11


def check_factors(ks: list[int], n_normal: int) -> None:
    if max(ks) > n_normal:
        raise ValueError("the number of latent factors cannot exceed the number of normal cells")


def model_scores(rows: DataFrame, n_parameters: int) -> DataFrame:
    """aic, bic, rss from count, yhat and alpha; n_parameters is K, each bin and cell has as many."""
    mean = F.col("yhat") * F.col("alpha") / 2
    loglik = F.sum(F.col("count") * F.ln(F.greatest(mean, F.lit(1.0))) - mean)
    sums = rows.agg(loglik.alias("ll"), F.count("*").alias("n"), F.sum(F.pow(F.col("count") - mean, 2)).alias("ss"), F.countDistinct("cell").alias("cells"), F.countDistinct("bin_idx").alias("bins"))
    p = n_parameters * (F.col("cells") + F.col("bins"))
    return sums.select((2 * F.col("ll") - 2 * p).alias("aic"), (2 * F.col("ll") - p * F.ln("n")).alias("bic"), (F.col("ss") / F.col("n")).alias("rss"))


def best_k(scores: DataFrame) -> DataFrame:
    """The K with the largest bic; the smaller one on ties."""
    return scores.agg(F.max_by("k", F.struct("bic", -F.col("k"))).alias("k"))


def best_fit(normalised: dict[str, DataFrame]) -> DataFrame:
    """The fit of the K that the scores choose, out of what normalise returns."""
    return normalised["fit"].join(F.broadcast(best_k(normalised["scores"])), "k")


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def bin_major(rows: DataFrame, *values: str) -> DataFrame:
    """One row per bin: values as arrays in the order of cells."""
    out = rows.groupBy("bin_idx").agg(F.array_sort(F.collect_list(F.struct("cell", *values))).alias("rows_"))
    return out.select("bin_idx", *(F.col(f"rows_.{v}").alias(v) for v in values))


def _log_rest(batch: pd.DataFrame) -> np.ndarray:
    """Log counts over expectation, bins x cells, centred per bin."""
    rest = np.log(np.maximum(np.stack(batch["count"].to_numpy()).astype(float), 1)) - np.stack(batch["base"].to_numpy())
    return rest - rest.mean(axis=1, keepdims=True)


def gram_times(by_bin: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'X times a block of vectors over cells, X being the log rest of all bins: tasks multiply their bins, Spark sums."""
    width = block.shape[1]

    def run(batches):
        total = np.zeros(block.shape)
        for b in batches:
            rest = _log_rest(b)
            total += rest.T @ (rest @ block)
        yield pd.DataFrame({"at": np.arange(len(total)), "values": list(total)})

    parts = by_bin.mapInPandas(run, "at int, values array<double>")
    sums = parts.groupBy("at").agg(F.array(*(F.sum(F.col("values")[j]) for j in range(width))).alias("values"))
    return np.stack(sums.orderBy("at").toPandas()["values"].to_numpy())


def first_factors(by_bin: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """h from log counts over expectation: the top k right singular vectors of bins x cells, by randomised block iteration.

    A block of k + SPARE_VECTORS random vectors goes through the bins again and again; what each pass adds is kept as
    a basis (a block Krylov space), and the best vectors within it are taken once they change no more. Nothing of
    cells x cells is made: the driver holds a few vectors over cells for each pass.
    """
    cells = by_bin.select(F.size("count")).first()[0]
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(cells, min(cells, k + SPARE_VECTORS))))[0]
    basis, images = block, np.zeros((cells, 0))
    for _ in range(MOST_PASSES):
        image = gram_times(by_bin, block)
        images = np.hstack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        found = basis @ inner
        if basis.shape[1] == cells or np.linalg.norm(images @ inner - found * values) <= SETTLED_VECTORS * max(values[0], 1e-300):
            break
        for _ in range(2):  # twice, as rounding leaves a part of the basis in it
            image = image - basis @ (basis.T @ image)
        left, size, _ = np.linalg.svd(image, full_matrices=False)
        block = left[:, size > SETTLED_VECTORS * max(values[0], 1e-300)][:, : cells - basis.shape[1]]
        if not block.shape[1]:
            break
        basis = np.hstack([basis, block])
    return signed(found)


def limited(g: np.ndarray) -> np.ndarray:
    """Extreme values of each factor are drawn in, once any is extreme."""
    g = g.copy()
    if g.max() >= G_LIMIT:
        high = np.quantile(g, 1 - G_TAIL, axis=0)
        g = np.where(g > high, np.minimum(high, G_LIMIT), g)
    if g.min() <= -G_LIMIT:
        low = np.quantile(g, G_TAIL, axis=0)
        g = np.where(g < low, np.maximum(low, -G_LIMIT), g)
    return g


def bin_factors(y: np.ndarray, base: np.ndarray, h: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """g of some bins: counts in normal cells on their h, offset by the log expectation; by least squares where that fails."""
    y, base, x = y[:, normal], base[:, normal], h[normal]
    g, ok = poisson.regress(y, x, base)
    if not ok.all():
        g[~ok] = poisson.least_squares(y[~ok], x, base[~ok])
    return np.nan_to_num(g, nan=0.0, posinf=0.0, neginf=0.0)


def cell_factors(y: np.ndarray, base: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Coefficients of some cells: counts over all bins on g."""
    return np.nan_to_num(poisson.regress(y, g, base)[0])


def product_vectors(g: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Right singular vectors of the product of g (centred over bins) and the cells' coefficients: of rank k, so by k x k algebra."""
    _, size, right = np.linalg.svd(g - g.mean(axis=0), full_matrices=False)
    return signed(np.linalg.svd(fitted @ (right.T * size), full_matrices=False)[0][:, : g.shape[1]])


def settled(changes: list[float]) -> bool:
    """Whether h changes no more, or, late, changes as little as in the best few rounds."""
    last, done = changes[-1], len(changes)
    return last < FACTOR_CHANGE or (done > SETTLED_FROM and sorted(changes + [np.inf] * (MOST_INNER - done)).index(last) < AMONG)


def task_slots(spark: SparkSession) -> int:
    """How many tasks the application can run at the same time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def factor_rounds(by_bin: DataFrame, by_cell: DataFrame, normal: np.ndarray, k: int, tasks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """g (by bin number) and h (by cell, in order) in turns until h settles, all in one barrier stage.

    Each task keeps its bins and its cells. In a round it fits g of its bins, the tasks exchange g, it fits its cells'
    coefficients, and the tasks exchange those; the first task takes the new h from them and tells the others whether
    to go on. Only g and h, a few numbers a bin and a cell, are exchanged. If a task is lost the stage runs again from
    the stored rows. `tasks` have to run at the same time: as many as the application has slots for unless given.
    """
    h0 = first_factors(by_bin, k)
    tasks = tasks or task_slots(by_bin.sparkSession)
    order = by_cell.select("cell", (F.row_number().over(Window.orderBy("cell")) - 1).alias("at"))
    of_bins = by_bin.select(F.lit(True).alias("is_bin"), (F.col("bin_idx") - 1).cast("int").alias("at"), "count", "base")
    of_cells = by_cell.join(F.broadcast(order), "cell").select(F.lit(False).alias("is_bin"), "at", "count", "base")
    rows = of_bins.unionByName(of_cells).repartition(tasks, "is_bin", "at")

    def run(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        batches = list(batches)
        mine = {}
        for is_bin in (True, False):
            some = [b[b["is_bin"] == is_bin] for b in batches]
            at = np.concatenate([np.zeros(0, np.int64), *(b["at"].to_numpy(np.int64) for b in some)])
            y, base = (np.array([v for b in some for v in b[c]], float) for c in ("count", "base"))
            mine[is_bin] = at, y, base

        def exchanged(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            parts = [b64decode(x) for x in context.allGather(b64encode(np.column_stack([at, values]).tobytes()).decode())]
            every = np.concatenate([np.frombuffer(x).reshape(-1, k + 1) for x in parts])
            return every[np.argsort(every[:, 0], kind="stable"), 1:]

        h, changes, going = h0, [], True
        while going:
            at, y, base = mine[True]
            g = limited(exchanged(at, bin_factors(y, base, h, normal) if len(at) else np.zeros((0, k))))
            at, y, base = mine[False]
            fitted = exchanged(at, cell_factors(y, base, g) if len(at) else np.zeros((0, k)))
            said = ""
            if context.partitionId() == 0:
                new = product_vectors(g, fitted)
                changes.append(float(np.mean((new - h) ** 2)))
                said = b64encode(bytes([settled(changes) or len(changes) == MOST_INNER]) + np.ascontiguousarray(new).tobytes()).decode()
            told = b64decode(context.allGather(said)[0])
            going, h = not told[0], np.frombuffer(told[1:]).reshape(-1, k)
        if context.partitionId() == 0:
            for is_bin, values in ((True, g), (False, h)):
                yield pd.DataFrame({"is_bin": is_bin, "at": np.arange(len(values)), "values": list(values)})

    found = rows.mapInPandas(run, "is_bin boolean, at int, values array<double>", barrier=True).toPandas().sort_values("at")
    return tuple(np.stack(found[found["is_bin"] == is_bin]["values"].to_numpy()) for is_bin in (True, False))


def with_effect(rows: DataFrame, g: np.ndarray, h: np.ndarray, names: list[str]) -> DataFrame:
    """Adds gh, the product of the bin's and the cell's factors. g and h have a row for each bin and each cell; the product is made in the tasks."""
    spark = rows.sparkSession
    of_bin = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(g)], "bin_idx int, g_ array<double>")
    of_cell = spark.createDataFrame([(c, v.tolist()) for c, v in zip(names, h)], "cell string, h_ array<double>")
    product = F.aggregate(F.zip_with("g_", "h_", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return rows.join(F.broadcast(of_bin), "bin_idx").join(F.broadcast(of_cell), "cell").withColumn("gh", product).drop("g_", "h_")


def normalise(
    depth: DataFrame, bins: DataFrame, cells: DataFrame, beta0: np.ndarray, ks: list[int], states: list[int], min_count: float = 20, by_clone: bool = False,
) -> dict[str, DataFrame]:
    """fit (k, cell, bin_idx, count, yhat, fgc, alpha), scores (k, aic, bic, rss), beta, g and h per k.

    cells: cell, is_normal, ploidy, and clone with by_clone. beta0 is the bin bias of the first pass. The restarts
    of the copy states begin from the same initial alpha in every round. states should begin with 1.
    """
    with passing(depth.sparkSession) as kept:
        return _normalise(depth, bins, cells, beta0, ks, states, min_count, by_clone, kept)


def _normalise(depth, bins, cells, beta0, ks, states, min_count, by_clone, kept) -> dict[str, DataFrame]:
    spark = depth.sparkSession
    info = cells.select("cell", "is_normal", "ploidy", *(["clone"] if by_clone else [])).orderBy("cell").toPandas()
    normal = np.flatnonzero(info["is_normal"].to_numpy(bool))
    check_factors(ks, len(normal))
    gc = firstpass.gc_of(bins)
    depth = stored(depth.select("cell", "bin_idx", "count"), "depth")
    libs = stored(qc.library_sizes(depth), "libs")
    cells = stored(cells, "cells")
    n_cells, names = len(info), info["cell"].tolist()
    place = {c: i for i, c in enumerate(names)}
    wide = firstpass.packed(depth, "count").join(F.broadcast(libs), "cell").join(F.broadcast(cells.select(*info.columns)), "cell")

    def with_ratio(frame: DataFrame, beta: np.ndarray, g: np.ndarray, h: np.ndarray) -> DataFrame:
        """Adds ratio and offset: counts over, and the product of, library size, bin bias and latent effect."""

        def run(batches):
            for b in batches:
                offsets = [n * beta * np.exp(g @ h[place[c]]) for c, n in zip(b["cell"], b["lib_size"])]
                b["offset"] = [o.tolist() for o in offsets]
                b["ratio"] = [(np.asarray(y, float) / o).tolist() for y, o in zip(b["count"], offsets)]
                yield b

        schema = ", ".join(f"{n} {t}" for n, t in frame.dtypes) + ", offset array<double>, ratio array<double>"
        return frame.mapInPandas(run, schema)

    def curves(frame: DataFrame) -> DataFrame:
        return em.fit_clones(frame, gc, states, min_count) if by_clone else em.fit_cells(frame, gc, states, min_count)

    none = np.zeros((len(gc), 1)), np.zeros((n_cells, 1))
    alpha0 = stored(em.initial_alpha(with_ratio(wide, beta0, *none), gc), "alpha")
    start = stored(curves(alpha0), "start")
    # The copy numbers of this first fit are what every later round starts from.
    again = alpha0.drop("ratio", "offset", "alpha").join(start.select("cell", "alpha"), "cell")
    again = stored(again, "again")
    fits, scores, betas, gs, hs = [], [], [], [], []
    for k in ks:
        beta, g, h = beta0, np.zeros((len(gc), k)), np.zeros((n_cells, k))
        before, best, least = None, None, np.inf
        for round_no in range(1, MOST_ROUNDS + 1):
            with passing(spark) as held:
                found = start if round_no == 1 else curves(with_ratio(again, beta, g, h))
                flat = stored(firstpass.long_form(found, "curve", "alpha"), "raw-curves")
                flat = held(flat.withColumn("curve", F.greatest("curve", F.lit(low_quantile(flat, "curve")))), "curves")
                rows = with_effect(depth.join(F.broadcast(libs), "cell").join(flat, ["cell", "bin_idx"]), g, h, names)
                rows = stored(rows, "rows")
                ratios = rows.join(F.broadcast(cells.where("is_normal").select("cell")), "cell", "left_semi").select("bin_idx", (F.col("count") / (F.col("curve") * F.col("lib_size") * F.exp("gh"))).alias("ratio"))
                new = firstpass.bin_bias(ratios).orderBy("bin_idx").toPandas()["beta"].to_numpy(float)
                bias_change = float(np.mean((new - beta) ** 2))
                change = flat.agg(F.avg(F.pow("curve", F.lit(2)))).first()[0] if before is None else flat.join(before, ["cell", "bin_idx"]).agg(F.avg(F.pow(F.col("curve") - F.col("old_"), 2))).first()[0]
                if change > least:
                    break
                least, beta, before = change, new, flat.select("cell", "bin_idx", F.col("curve").alias("old_"))
                values = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(beta)], "bin_idx int, beta double")
                based = rows.join(F.broadcast(values), "bin_idx").withColumn("base", F.ln(F.col("lib_size") * F.col("curve") * F.col("beta") * F.col("alpha") / 2))
                based = held(based, "based")
                g, h = factor_rounds(stored(bin_major(based, "count", "base"), "by-bin"), stored(firstpass.packed(based, "count", "base"), "by-cell"), normal, k)
                best = (based.drop("gh"), beta, g, h)
            if firstpass.should_stop(round_no, bias_change):
                break
        based, beta, g, h = best
        yhat = F.greatest(F.rint(F.col("curve") * F.col("lib_size") * F.col("beta") * F.exp("gh")), F.lit(1.0))
        fit = with_effect(based, g, h, names).select(F.lit(k).alias("k"), "cell", "bin_idx", "count", yhat.alias("yhat"), signif(F.col("curve")).alias("fgc"), "alpha")
        fit = kept(fit, "fit")
        fits.append(fit)
        scores.append(model_scores(fit, k).select(F.lit(k).alias("k"), "aic", "bic", "rss"))
        betas.append(spark.createDataFrame([(k, i + 1, float(v)) for i, v in enumerate(beta)], "k int, bin_idx int, beta double"))
        gs.append(spark.createDataFrame([(k, i + 1, v.tolist()) for i, v in enumerate(g)], "k int, bin_idx int, g array<double>"))
        hs.append(spark.createDataFrame([(k, c, v.tolist()) for c, v in zip(names, h)], "k int, cell string, h array<double>"))

    def stacked(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return {
        "fit": stacked(fits), "scores": stacked(scores), "beta": stacked(betas).withColumn("beta", signif(F.col("beta"))),
        "g": stacked(gs).withColumn("g", F.transform("g", lambda x: signif(x))), "h": stacked(hs).withColumn("h", F.transform("h", lambda x: signif(x))),
    }
