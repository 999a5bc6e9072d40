"""Cross-sample segmentation: the scan statistic over all windows of each chromosome, summed over cells.

`fit` has chrom, cell, pos (1.. in the chromosome), count and yhat. All chromosomes run in one job. Deviations
from the published method, on purpose: nested scans use the true flanks of a window inside its segment, and a
segment without a statistic (one bin) is dropped alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import segments as kernel
from ..functions.tables import passing, stored

FLOOR = 10.0
#: Windows that a task hands on at once.
WINDOWS_AT_ONCE = 200_000


def with_positions(fit: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds chrom and pos, the bin's place in its chromosome."""
    by_chrom = Window.partitionBy("chrom").orderBy("bin_idx")
    placed = bins.select("chrom", "bin_idx", F.row_number().over(by_chrom).alias("pos"))
    return fit.join(F.broadcast(placed), "bin_idx")


def on_chromosome(fit: DataFrame, bins: DataFrame, chrom: str) -> DataFrame:
    if not bins.where(F.col("chrom") == chrom).limit(1).count():
        raise ValueError(f"chromosome {chrom} is not among the bins")
    return fit.where(F.col("chrom") == chrom)


def clipped(fit: DataFrame, *key: str) -> DataFrame:
    """Low expectations raised to FLOOR; counts too, on all such bins of a (chrom, cell) if one of them is low."""
    low = F.col("yhat") < FLOOR
    any_low = F.max(low & (F.col("count") < FLOOR)).over(Window.partitionBy("chrom", "cell", *key))
    return fit.withColumn("y", F.when(low & any_low, FLOOR).otherwise(F.col("count").cast("double"))).withColumn("lambda", F.when(low, FLOOR).otherwise(F.col("yhat").cast("double")))


def prefix_sums(clip: DataFrame, *key: str) -> DataFrame:
    """Running sums sy and sl of y and lambda along each chromosome of each cell, and the totals ty and tl."""
    along = Window.partitionBy("chrom", "cell", *key)
    upto = along.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return clip.select("chrom", "cell", *key, "pos", "y", "lambda", F.sum("y").over(upto).alias("sy"), F.sum("lambda").over(upto).alias("sl"), F.sum("y").over(along).alias("ty"), F.sum("lambda").over(along).alias("tl"))


def likelihood_part(y: Column, lam: Column) -> Column:
    """Log likelihood ratio of the best whole copy number against two copies."""
    c = F.coalesce(F.rint(2 * F.try_divide(y, lam)), F.lit(2.0))
    return (1 - c / 2) * lam + F.ln((c + 1e-4) / 2.0001) * y


def scan(prefix: DataFrame, *key: str) -> DataFrame:
    """chrom, i, j, z for every window i < j: built-in functions only, for up to some hundred bins a chromosome."""
    a = prefix.select("chrom", "cell", *key, F.col("pos").alias("i"), (F.col("sy") - F.col("y")).alias("y0"), (F.col("sl") - F.col("lambda")).alias("l0"))
    b = prefix.select("chrom", "cell", *key, F.col("pos").alias("j"), F.col("sy").alias("y1"), F.col("sl").alias("l1"), "ty", "tl")
    w = a.join(b, ["chrom", "cell", *key]).where("i < j")
    value = likelihood_part(F.col("y1") - F.col("y0"), F.col("l1") - F.col("l0")) + likelihood_part(F.col("y0"), F.col("l0")) + likelihood_part(F.col("ty") - F.col("y1"), F.col("tl") - F.col("l1"))
    return w.groupBy("chrom", *key, "i", "j").agg(F.sum(value).alias("z"))


def packed_cells(placed: DataFrame) -> DataFrame:
    """One row per chromosome and cell: counts and expectations as arrays in the order of bins."""
    rows = placed.groupBy("chrom", "cell").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "yhat"))).alias("rows_"))
    return rows.select("chrom", "cell", F.col("rows_.count").cast("array<double>").alias("y"), F.col("rows_.yhat").cast("array<double>").alias("lambda"))


def scan_packed(packed: DataFrame, ranges: DataFrame, cells_per_task: int = 256, bins_per_task: int = 1000) -> DataFrame:
    """chrom, seg, i, j, z for every window inside each range (chrom, st, ed); seg is the range's first bin.

    A task has some cells of a chromosome and cuts the windows of all its ranges from their packed rows, so a row is
    there once for all ranges, and only sums over cells leave the task. A chromosome of more than bins_per_task bins
    has several tasks for its first bins.
    """
    blocks = max(1, -(-packed.select("cell").distinct().count() // cells_per_task))
    # As many ranges as bins at most.
    of_chrom = ranges.groupBy("chrom").agg(F.collect_list(F.struct(F.col("st").cast("long").alias("st"), F.col("ed").cast("long").alias("ed"))).alias("ranges"))
    parts = F.ceil(F.size("y") / bins_per_task).cast("int")
    rows = packed.join(F.broadcast(of_chrom), "chrom").withColumn("cells_", F.pmod(F.xxhash64("cell"), F.lit(blocks)))
    rows = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def summed(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = pd.concat(batches)
        y, lam = (np.stack(some[c].to_numpy()).astype(float) for c in ("y", "lambda"))
        found, size = [], 0
        for r in some["ranges"].iloc[0]:
            clipped_ = kernel.clip(y[:, r["st"] - 1 : r["ed"]], lam[:, r["st"] - 1 : r["ed"]], FLOOR)
            for i, j, z in kernel.window_sums(*clipped_, key[1], int(some["parts"].iloc[0])):
                found.append(pd.DataFrame({"chrom": key[0], "seg": r["st"], "i": r["st"] + i, "j": r["st"] + j, "z": z}))
                size += len(j)
                if size > WINDOWS_AT_ONCE:
                    yield pd.concat(found)
                    found, size = [], 0
        if found:
            yield pd.concat(found)

    schema = "chrom string, seg long, i long, j long, z double"
    return rows.groupBy("chrom", "part", "cells_").applyInPandas(summed, schema).groupBy("chrom", "seg", "i", "j").agg(F.sum("z").alias("z"))


def non_overlapping(windows: DataFrame) -> DataFrame:
    """Of windows (chrom, seg, i, j, z) those that a choice by falling z takes, each time leaving out what overlaps one taken before.

    The choice goes in rounds: a window that beats all windows it overlaps is taken, and those it overlaps go. For each
    bin the best window over it is found: of windows with the same first bin only those matter that beat all longer
    ones, and each is the best of its first bin from behind the next shorter of them up to its own end. A window is
    taken if it is the best over every one of its bins. Ties go to the smaller first, then last, bin.
    """
    along = ["chrom", "seg"]
    left, parts = windows, []
    while True:
        first = Window.partitionBy(*along, "i").orderBy(F.desc("j"))
        longer = first.rowsBetween(Window.unboundedPreceding, -1)
        rows = left.withColumn("key", F.struct("z", -F.col("i"), -F.col("j"))).withColumn("over_", F.max("key").over(longer))
        steps = rows.where("over_ IS NULL OR key > over_").withColumn("from_", F.coalesce(F.lead("j").over(first) + 1, "i"))
        over = steps.select(*along, "key", "i", "j", "z", F.explode(F.sequence("from_", "j")).alias("bin"))
        best = over.groupBy(*along, "bin").agg(F.max(F.struct("key", "i", "j", "z")).alias("w")).select(*along, "bin", "w.i", "w.j", "w.z")
        best = stored(best, "best")
        if best.isEmpty():
            break
        whole = Window.partitionBy(*along, "i", "j")
        best = best.withColumn("taken", F.count("*").over(whole) == F.col("j") - F.col("i") + 1)
        parts.append(best.where("taken").select(*along, "i", "j", "z").distinct())
        # Bins of taken windows part the others; what reaches over one of them goes. One row a bin.
        gaps = stored(best.select(*along, "bin", "taken", F.sum(F.col("taken").cast("int")).over(Window.partitionBy(*along).orderBy("bin")).alias("gap")).where("NOT taken"), "gaps")
        ends = [F.broadcast(gaps.select(*along, F.col("bin").alias(x), F.col("gap").alias(f"gap_{x}"))) for x in ("i", "j")]
        left = stored(left.join(ends[0], [*along, "i"]).join(ends[1], [*along, "j"]).where("gap_i = gap_j").select(*along, "i", "j", "z"), "windows")
    out = windows.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def picked_segments(z: DataFrame, ranges: DataFrame) -> DataFrame:
    """chrom, seg, st, ed, is_nested: the windows chosen by falling statistic, repaired at the borders and filled up to tile each range.

    z: windows chrom, seg, i, j, z; ranges: chrom, st, ed. seg is the first bin of a window's range.
    """
    along = ["chrom", "seg"]
    positive = stored(z.where("z > 0").select(*along, "i", "j", "z"), "windows")
    taken = stored(non_overlapping(positive), "taken")
    strong = taken.where(f"j - i > {kernel.LEAST_LENGTH} AND z > {kernel.LEAST_Z}")
    spans = ranges.select("chrom", F.col("st").cast("long").alias("seg"), F.col("ed").cast("long").alias("end"))
    outer = strong.groupBy(*along).agg(F.min("i").alias("low"), F.max("j").alias("high"), F.collect_list(F.struct("i", "j", "z")).alias("windows"))
    spans = spans.join(outer, along, "left")
    # Whether the flanks outside all windows have a positive statistic themselves.
    for name, flank in (("before", (F.col("seg"), F.col("low") - 1)), ("after", (F.col("high") + 1, F.col("end")))):
        found = positive.join(F.broadcast(spans.select(*along, flank[0].alias("i"), flank[1].alias("j"))), [*along, "i", "j"], "left_semi").select(*along, F.lit(True).alias(name))
        spans = spans.join(found, along, "left")

    def tiled_ranges(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                windows = sorted((-w["z"], int(w["i"]), int(w["j"])) for w in (row.windows if row.windows is not None else ()))
                windows = [[i, j, round(-less, 3)] for less, i, j in windows]
                found, nested = kernel.repaired(windows, int(row.seg), int(row.end), row.before is True, row.after is True)
                out += [(row.chrom, row.seg, int(x), int(y), nested) for x, y in found]
            yield pd.DataFrame(out, columns=["chrom", "seg", "st", "ed", "is_nested"])

    return spans.select(*along, "end", "windows", "before", "after").mapInPandas(tiled_ranges, "chrom string, seg long, st long, ed long, is_nested int")


def ranked_segments(z: DataFrame, chosen: DataFrame) -> DataFrame:
    """Segments with their statistic in the first scan, falling; those without one are dropped. rank counts from 1."""
    rows = chosen.join(z, (chosen["chrom"] == z["chrom"]) & (chosen["st"] == z["i"]) & (chosen["ed"] == z["j"])).select(chosen["chrom"], "st", "ed", "z")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(F.desc("z"), "st")))


def nested_search(packed: DataFrame, first: DataFrame, rounds: int) -> DataFrame:
    """Re-scan inside each segment, up to `rounds` times; nested ones are replaced by what is found in them."""
    chosen = first.select("chrom", "st", "ed")
    for _ in range(rounds):
        found = stored(picked_segments(scan_packed(packed, chosen), chosen), "nested")
        nested = found.where("is_nested = 1")
        if nested.isEmpty():
            break
        split = nested.select("chrom", F.col("seg").alias("st")).distinct()
        chosen = stored(chosen.join(F.broadcast(split), ["chrom", "st"], "left_anti").unionByName(nested.select("chrom", "st", "ed")), "chosen")
    return chosen


def model_scores(fit: DataFrame, ranked: DataFrame) -> DataFrame:
    """chrom, rank, mbic: the modified BIC of the segments up to each rank.

    Segments are at most as many as bins and go to the tasks; each (chrom, cell) yields its share of likelihood,
    carriers and squared jumps, which Spark sums over cells.
    """
    by_chrom: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.orderBy("chrom", "rank").select("chrom", "st", "ed").collect():
        by_chrom.setdefault(r["chrom"], []).append((r["st"], r["ed"]))

    def shares(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        chrom = group["chrom"].iloc[0]
        rows = kernel.cell_shares(group["count"].to_numpy(np.float64), group["yhat"].to_numpy(np.float64), by_chrom.get(chrom, []))
        return pd.DataFrame([(chrom, *r) for r in rows], columns=["chrom", "rank", "r", "loglik", "carriers", "jump", "inner"])

    per_cell = fit.groupBy("chrom", "cell").applyInPandas(shares, "chrom string, rank long, r long, loglik double, carriers double, jump double, inner long")
    summed = per_cell.groupBy("chrom", "rank", "r").agg(F.sum("loglik").alias("loglik"), F.sum("carriers").alias("carriers"), F.sum("jump").alias("jump"), F.max("inner").alias("inner"))
    summed = summed.groupBy("chrom", "rank").agg(F.sum("loglik").alias("loglik"), F.sum("carriers").alias("carriers"), F.max("jump").alias("jump"), F.max("inner").alias("inner"))
    size = fit.groupBy("chrom").agg(F.countDistinct("cell").alias("cells"), F.max("pos").alias("bins"))

    def formula(batches):
        for b in batches:
            b["mbic"] = [kernel.modified_bic(*r) for r in zip(b["loglik"], b["carriers"], b["jump"], b["inner"], b["cells"], b["bins"])]
            yield b[["chrom", "rank", "mbic"]]

    return summed.join(F.broadcast(size), "chrom").mapInPandas(formula, "chrom string, rank long, mbic double")


def pooled(ranked: DataFrame, scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """chrom, st, ed: the segments up to the best score (the first one on ties), filled up to tile the chromosome.

    sizes has chrom and bins. A chromosome without a segment is one segment.
    """
    best = scores.where(~F.isnan("mbic")).groupBy("chrom").agg(F.max_by("rank", F.struct("mbic", -F.col("rank"))).alias("best_"))
    kept = ranked.join(F.broadcast(best), "chrom").where("rank <= best_").select("chrom", "st", "ed")
    return tiled(kept, sizes)


def tiled(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Segments and the gaps before, between and after them."""
    along = Window.partitionBy("chrom").orderBy("st")
    rows = segments.withColumn("gap_st_", F.coalesce(F.lag("ed").over(along) + 1, F.lit(1))).withColumn("gap_ed_", F.col("st") - 1)
    gaps = rows.where("gap_st_ <= gap_ed_").select("chrom", F.col("gap_st_").alias("st"), F.col("gap_ed_").alias("ed"))
    ends = sizes.join(segments.groupBy("chrom").agg(F.max("ed").alias("last_")), "chrom", "left").select("chrom", (F.coalesce("last_", F.lit(0)) + 1).alias("st"), F.col("bins").alias("ed")).where("st <= ed")
    return segments.select("chrom", "st", "ed").unionByName(gaps).unionByName(ends)


def segment_genome(fit: DataFrame, bins: DataFrame, mode: str = "integer", max_ns: int = 0) -> dict[str, DataFrame]:
    """The whole of it, for all chromosomes: segments (global bin numbers), calls and profile. fit: cell, bin_idx, count, yhat."""
    from . import calls

    with passing(fit.sparkSession) as kept:
        placed = kept(with_positions(fit, bins), "placed")
        sizes = kept(placed.groupBy("chrom").agg(F.max("pos").alias("bins"), F.min("bin_idx").alias("first")), "sizes")
        packed = stored(packed_cells(placed), "packed")
        ranges = sizes.select("chrom", F.lit(1).cast("long").alias("st"), F.col("bins").cast("long").alias("ed"))
        z = stored(scan_packed(packed, ranges), "scan")
        chosen = stored(picked_segments(z, ranges).select("chrom", "st", "ed"), "chosen")
        if max_ns:
            chosen = nested_search(packed, chosen, max_ns)
        ranked = stored(ranked_segments(z, chosen), "ranked")
        segments = kept(pooled(ranked, model_scores(placed, ranked), sizes), "segments")
    numbers = calls.copy_numbers(placed, segments, mode)
    shifted = segments.join(F.broadcast(sizes), "chrom").select("chrom", (F.col("st") + F.col("first") - 1).alias("st_bin"), (F.col("ed") + F.col("first") - 1).alias("ed_bin"))
    return {"segments": shifted, "calls": calls.call_table(numbers, sizes), "profile": calls.profile(placed, numbers)}
