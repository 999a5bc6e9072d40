"""Registered queries of the copy-number operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import low_quantile, signif
from ..functions.tables import stored
from ..operators import bins as b
from ..operators import calls, coverage, gini, ploidy, qc, segment, views
from ..sources import reads as reads_source
from ..sources.tables import SQL
from .workloads import Workload, flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"normal_cells": flagship}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a workload under its name, with the SQL that follows the shared table expressions."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"with {SQL.strip()},\n{DEPTH.strip()}\n{sql.strip()}"
        return f

    return register


def six(*names: str):
    return [F.bround(n, 6).alias(n) for n in names]


DEPTH = """
kept as (select r.* from reads r where (flag & 1605) = 65 and mapq >= 1 and chrom is not null
  and not exists (select 1 from mask m where m.chrom = r.chrom and r.pos <= m."end" and r.pos + r.qwidth - 1 >= m."start")),
touched as (select cell, k.chrom, unnest(range((pos - 1) // w, (pos + qwidth - 2) // w + 1)) bin_no from kept k, (select any_value(w) w from chroms)),
seen as (select cell, bin_idx, count(*) n from touched join bins using (chrom, bin_no) group by all),
depth as (select c.cell, b.bin_idx, coalesce(n, 0) "count" from (select distinct cell from reads) c cross join bins b left join seen s on s.cell = c.cell and s.bin_idx = b.bin_idx),
gc_bins as (select chrom, bin_no, round_even(100.0 * sum(length(regexp_replace(upper(p), '[^GC]', '', 'g'))) / sum(length(p)), 2) gc from (
  select s.chrom, bin_no, substr(seq, cast(greatest(s."start", b."start") - s."start" + 1 as int), cast(least(s."start" + length(seq) - 1, b."end") - greatest(s."start", b."start") + 1 as int)) p
  from seq_chunks s join bins b on s.chrom = b.chrom and s."start" <= b."end" and s."start" + length(seq) - 1 >= b."start"  ) where p <> '' group by all),
mapp_bins as (select b.chrom, b.bin_no, sum(score * o) / sum(o) mapp from (
  select b.chrom, b.bin_no, score, least(t."end", b."end") - greatest(t."start", b."start") + 1 o from mapp_track t join bins b on t.chrom = b.chrom and t."start" <= b."end" and t."end" >= b."start") b group by all),
annotated as (select b.*, g.gc, coalesce(m.mapp, 1.0) mapp from bins b left join gc_bins g using (chrom, bin_no) left join mapp_bins m using (chrom, bin_no)),
totals as (select cell, sum("count") total from depth group by cell),
normal as (select d.* from depth d join clones using (cell) where clone = 'normal'),
per_bin as (select bin_idx, avg("count") mean from normal group by bin_idx),
fit as (select d.cell, d.bin_idx, d."count", greatest(1.0, round_even(mean * total / whole, 0)) yhat
  from depth d join totals using (cell) join per_bin using (bin_idx), (select sum("count") / count(distinct cell) whole from normal)),
placed as (select f.*, b.chrom, row_number() over (partition by f.cell, b.chrom order by f.bin_idx) pos from fit f join bins b using (bin_idx)),
metrics as (select cell, round_even(avg(qwidth), 0) readlength, count(*) total, count(chrom) mapped, count(*) filter (chrom is not null and flag < 1024) non_dup,
  count(*) filter (flag < 1024 and mapq >= 20) mapq20 from reads group by cell)
"""

GINI = """, sorted as (select cell, "count", row_number() over (partition by cell order by "count", bin_idx) r from depth),
lorenz as (select cell, sum("count") over (partition by cell order by r) cum from sorted),
gini as (select cell, 2 * round_even(0.5 - (sum(cum) / max(cum) - 0.5) / count(*), 4) gini from lorenz group by cell)
"""
ORACLE_SQL["normal_cells"] = f"with {SQL.strip()},\n{DEPTH.strip()}{GINI} select cell, round_even(gini, 6) gini, gini <= 0.12 is_normal, gini > 0.5 excluded from gini"


@query("""select chrom, bin_no, "start", "end", bin_idx, chrom || ':' || "start" || '-' || "end" as label from bins""")
def genome_bins(w):
    return b.labelled(w.bins()).select("chrom", "bin_no", "start", "end", F.col("bin_idx").cast("long").alias("bin_idx"), "label")


@query("select chrom, bin_no, gc from bins left join gc_bins using (chrom, bin_no)")
def bin_gc(w):
    return b.gc_content(w.bins(), w.inputs.seq_chunks(), w.width).select("chrom", "bin_no", "gc")


@query("select chrom, bin_no, round_even(mapp, 6) mapp from annotated")
def bin_mappability(w):
    return b.mappability(w.bins(), w.inputs.mapp_track(), w.width).select("chrom", "bin_no", *six("mapp"))


@query("""select chrom, bin_no, cast(1.0 as double) mapp from bins""")
def bin_mappability_mouse(w):
    return b.mappability(w.bins(), None, w.width, "mm10").select("chrom", "bin_no", "mapp")


@query("select cell, count(*) n, sum(pos) sum_pos from reads where (flag & 1605) = 65 and mapq >= 40 group by cell")
def paired_end_reads(w):
    return coverage.filtered(w.inputs.reads(), 40).groupBy("cell").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query("select cell, count(*) n from (select cell, mapq, flag - 65 flag from reads) where (flag & 1541) = 0 and mapq >= 20 group by cell")
def single_end_reads(w):
    return coverage.filtered(w.inputs.reads().withColumn("flag", F.col("flag") - 65), 20, "single").groupBy("cell").agg(F.count("*").alias("n"))


@query("select cell, case when cell < 'cell05' then chrom else 'chr' || substr(chrom, 4) end chrom, count(*) n from reads where chrom is not null group by all")
def chromosome_names(w):
    bare = w.inputs.reads().withColumn("chrom", F.when(F.col("cell") < "cell05", F.col("chrom")).otherwise(F.substring("chrom", 4, 10)))
    return coverage.with_chr_names(bare).where("chrom is not null").groupBy("cell", "chrom").agg(F.count("*").alias("n"))


@query("select cell, chrom, count(*) n, sum(pos) sum_pos from kept group by all")
def unmasked_reads(w):
    kept = coverage.unmasked(coverage.filtered(w.inputs.reads(), 1), w.inputs.mask())
    return kept.groupBy("cell", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query("""select cell, bin_idx, "count" from depth""")
def depth(w):
    return w.depth().select("cell", F.col("bin_idx").cast("long").alias("bin_idx"), "count")


@query("""select cell, readlength, total, mapped, round_even(mapped / total, 3) mapped_prop, non_dup, round_even(non_dup / total, 3) non_dup_prop, mapq20, round_even(mapq20 / total, 3) mapq20_prop from metrics""")
def qc_metrics(w):
    return w.metrics()


FACTORS = """, nonzero as (select bin_idx from depth group by bin_idx having min("count") > 0),
few as (select count(*) <= 10 few from nonzero),
pseudo as (select bin_idx, case when few then nullif(avg("count"), 0) else exp(avg(ln("count")) filter ("count" > 0)) end p from depth, few where few or bin_idx in (select bin_idx from nonzero) group by bin_idx, few),
factors as (select cell, median("count" / p) factor from depth join pseudo using (bin_idx) group by cell)
"""


@query(FACTORS + "select cell, round_even(factor, 6) factor from factors")
def size_factors(w):
    return qc.size_factors(stored(w.depth(), "depth")).select("cell", *six("factor"))


@query(FACTORS + "select cell, round_even(factor / (select median(factor) from factors) * (select median(total) from totals), 0) lib_size from factors")
def library_sizes(w):
    return qc.library_sizes(stored(w.depth(), "depth"))


QC = """, cells1 as (select cell from (select cell, sum("count") s, avg("count") a from depth group by cell) join metrics using (cell) where s > 0 and a > 1 and round_even(mapq20 / total, 3) >= 0.3),
bins1 as (select * from annotated where gc between 20 and 80 and mapp >= 0.9),
part1 as (select d.* from depth d where cell in (select cell from cells1) and bin_idx in (select bin_idx from bins1)),
nonzero as (select bin_idx from part1 group by bin_idx having min("count") > 0),
few as (select count(*) <= 10 few from nonzero),
pseudo as (select bin_idx, case when few then nullif(avg("count"), 0) else exp(avg(ln("count")) filter ("count" > 0)) end p from part1, few where few or bin_idx in (select bin_idx from nonzero) group by bin_idx, few),
factors as (select * from (select cell, median("count" / p) factor from part1 join pseudo using (bin_idx) group by cell) where factor > 0),
sums as (select bin_idx, sum("count" / factor) s from part1 join factors using (cell) group by bin_idx),
mid as (select median(s) m from sums),
dev as (select 1.4826 * median(abs(s - m)) d from sums, mid),
bins2 as (select bin_idx from sums, mid, dev where abs(s - m) <= 3 * d)
"""


@query(QC + "select chrom, bin_no, row_number() over (order by bin_idx) bin_idx from bins1 where bin_idx in (select bin_idx from bins2)")
def qc_bins(w):
    return w.quality_controlled()["bins"].select("chrom", "bin_no", F.col("bin_idx").cast("long").alias("bin_idx"))


@query(QC + """select cell, count(*) n, sum("count") total from part1 where cell in (select cell from factors) and bin_idx in (select bin_idx from bins2) group by cell""")
def qc_depth(w):
    return w.quality_controlled()["depth"].groupBy("cell").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query(QC + """select 'cells_depth_or_mapq' step, (select count(*) from metrics) - (select count(*) from cells1) n union all
select 'bins_gc_or_mapp', (select count(*) from annotated) - (select count(*) from bins1) union all
select 'cells_size_factor', (select count(*) from cells1) - (select count(*) from factors) union all
select 'bins_depth_outlier', (select count(*) from bins1) - (select count(*) from bins2)""")
def qc_removed(w):
    return w.quality_controlled()["removed"]


@query(GINI + "select cell, round_even(gini, 6) gini from gini")
def gini_coefficients(w):
    return gini.gini(w.depth()).select("cell", *six("gini"))


LEVELS = """, ratios as (select *, ("count" + 1) / (yhat + 1) ratio, min(pos) over (partition by cell, chrom) = pos is_start, max(bin_idx) over (partition by cell) last from placed),
segs as (select *, sum(is_start::int) over (partition by cell order by bin_idx) seg from ratios),
members as (select cell, seg, ratio from segs where bin_idx < last union all select cell, 1, ratio from segs where seg = 2 and is_start),
medians as (select cell, seg, median(ratio) m from members group by all),
raw as (select cell, bin_idx, case when bin_idx < last then m else 0 end lev from segs left join medians using (cell, seg)),
levels as (select cell, bin_idx, lev / avg(lev) over (partition by cell) "level" from raw),
grid as (select cast(round(1.5 + i * 0.05, 10) as double) x from range(91) t(i)),
errors as (select cell, x, sum(pow("level" * x - round_even("level" * x, 0), 2)) sos from levels, grid group by all),
clone_errors as (select clone, x, sum(sos) sos from errors join clones using (cell) group by all)
"""


def _levels(w):
    placed = segment.with_positions(w.expected(), w.bins())
    return ploidy.segment_levels(ploidy.normalised_ratio(placed), placed.where("pos = 1").select("cell", "bin_idx"))


@query(LEVELS + """select cell, bin_idx, round_even("level", 6) "level" from levels""")
def segment_levels(w):
    return _levels(w).select("cell", F.col("bin_idx").cast("long").alias("bin_idx"), *six("level"))


@query(LEVELS + "select cell, x, round_even(sos, 6) sos from errors")
def ploidy_errors(w):
    return ploidy.ploidy_errors(_levels(w)).select("cell", "x", *six("sos"))


@query(LEVELS + "select cell, arg_min(x, (round_even(sos, 9), x)) ploidy from errors group by cell")
def cell_ploidy(w):
    errors = ploidy.ploidy_errors(_levels(w)).withColumn("sos", F.bround("sos", 9))
    return ploidy.best_ploidy(errors)


@query(LEVELS + "select c.cell, clone, ploidy from clones c join (select clone, arg_min(x, (round_even(sos, 9), x)) ploidy from clone_errors group by clone) using (clone)")
def clone_ploidy(w):
    return ploidy.clone_ploidy(_levels(w), w.inputs.clones())


CLIP = """, clip as (select *, case when yhat < 10 and max((yhat < 10 and "count" < 10)::int) over (partition by chrom, cell) = 1 then 10e0 else cast("count" as double) end y, greatest(yhat, 10e0) lam from placed),
prefix as (select *, sum(y) over w sy, sum(lam) over w sl, sum(y) over (partition by chrom, cell) ty, sum(lam) over (partition by chrom, cell) tl from clip window w as (partition by chrom, cell order by pos)),
windows as (select a.chrom, a.cell, a.pos i, b.pos j, b.sy - a.sy + a.y yc, b.sl - a.sl + a.lam lc, a.sy - a.y yl, a.sl - a.lam ll, b.ty - b.sy yr, b.tl - b.sl lr
  from prefix a join prefix b on a.chrom = b.chrom and a.cell = b.cell and a.pos < b.pos),
copies as (select *, round_even(2 * yc / lc, 0) cc, case when ll = 0 then 2 else round_even(2 * yl / ll, 0) end cl, case when lr = 0 then 2 else round_even(2 * yr / lr, 0) end cr from windows),
z as (select chrom, i, j, sum((1 - cc / 2) * lc + ln((cc + 1e-4) / 2.0001) * yc + (1 - cl / 2) * ll + ln((cl + 1e-4) / 2.0001) * yl + (1 - cr / 2) * lr + ln((cr + 1e-4) / 2.0001) * yr) z from copies group by all)
"""


def _prefix(w):
    return segment.prefix_sums(segment.clipped(segment.with_positions(w.expected(), w.bins())))


def _windows(z):
    return z.select("chrom", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.bround("z", 3).alias("z"))


@query(CLIP + "select chrom, cell, pos, y, lam lambda_ from clip")
def clipped_depth(w):
    return segment.clipped(segment.with_positions(w.expected(), w.bins())).select("chrom", "cell", F.col("pos").cast("long").alias("pos"), "y", F.col("lambda").alias("lambda_"))


@query(CLIP + "select chrom, cell, pos, sy, sl from prefix")
def prefix_sums(w):
    return _prefix(w).select("chrom", "cell", F.col("pos").cast("long").alias("pos"), "sy", "sl")


@query(CLIP + "select chrom, i, j, round_even(z, 3) z from z")
def scan_statistic(w):
    return _windows(segment.scan(_prefix(w)))


@query(CLIP + "select chrom, i, j, round_even(z, 3) z from z")
def scan_statistic_blocks(w):
    placed = segment.with_positions(w.expected(), w.bins())
    ranges = placed.groupBy("chrom").agg(F.min("pos").alias("st"), F.max("pos").alias("ed"))
    return _windows(segment.scan_packed(segment.packed_cells(placed), ranges, cells_per_task=4, bins_per_task=8))


@query(CLIP + "select chrom, i, j, round_even(z, 3) z from z where z > 10 and j - i > 1")
def strong_windows(w):
    return _windows(segment.scan(_prefix(w)).where("z > 10 and j - i > 1"))


TILES = """, given as (select chrom, 6 st, 15 ed from chroms where chrom_rank % 2 = 0),
sizes as (select chrom, count(*) bins, min(bin_idx) first from bins group by chrom),
tiles as (select chrom, st, ed from given union all select chrom, 1, 5 from given union all select g.chrom, 16, bins from given g join sizes using (chrom)
  union all select chrom, 1, bins from sizes where chrom not in (select chrom from given)),
numbers as (select cell, p.chrom, st, ed, least(14.0, round_even(2 * sum("count") / sum(yhat), 0)) cn from placed p join tiles t on p.chrom = t.chrom and pos between st and ed group by all),
profile as (select p.cell, p.chrom, p.bin_idx, greatest(-2.0, least(2.0, ln(greatest("count", 0.001) / yhat))) image_orig,
  case when cn = 0 then cast('-inf' as double) else ln(cn / 2) end image_seg, cn icn from placed p join numbers n on n.cell = p.cell and n.chrom = p.chrom and pos between st and ed)
"""


def _given(w):
    bins = w.bins()
    sizes = bins.groupBy("chrom").agg(F.count("*").alias("bins"), F.min("bin_idx").alias("first"))
    given = w.inputs.chroms().where("chrom_rank % 2 = 0").select("chrom", F.lit(6).cast("long").alias("st"), F.lit(15).cast("long").alias("ed"))
    return segment.with_positions(w.expected(), bins), segment.tiled(given, sizes), sizes


@query(TILES + "select chrom, st, ed from tiles")
def tiled_segments(w):
    return _given(w)[1].select("chrom", F.col("st").cast("long").alias("st"), F.col("ed").cast("long").alias("ed"))


@query(TILES + "select cell, chrom, st, ed, cn from numbers")
def segment_copy_numbers(w):
    placed, tiles, _ = _given(w)
    return calls.copy_numbers(placed, tiles).select("cell", "chrom", F.col("st").cast("long").alias("st"), F.col("ed").cast("long").alias("ed"), "cn")


@query(TILES + """select p.cell, p.chrom, st, ed, round_even(least(14.0, 2 * sum("count") / sum(yhat)), 6) cn from placed p join tiles t on p.chrom = t.chrom and pos between st and ed group by all""")
def segment_copy_fractions(w):
    placed, tiles, _ = _given(w)
    return calls.copy_numbers(placed, tiles, "fraction").select("cell", "chrom", F.col("st").cast("long").alias("st"), F.col("ed").cast("long").alias("ed"), *six("cn"))


@query(TILES + "select cell sample_name, chrom, st + first - 1 st_bin, ed + first - 1 ed_bin, cn cnv_no from numbers join sizes using (chrom) where cn <> 2")
def call_table(w):
    placed, tiles, sizes = _given(w)
    return calls.call_table(calls.copy_numbers(placed, tiles), sizes).withColumn("st_bin", F.col("st_bin").cast("long")).withColumn("ed_bin", F.col("ed_bin").cast("long"))


def _profile(w):
    placed, tiles, _ = _given(w)
    return calls.profile(placed, calls.copy_numbers(placed, tiles))


@query(TILES + "select cell, chrom, bin_idx, round_even(image_orig, 6) image_orig, case when image_seg < -1e9 then image_seg else round_even(image_seg, 6) end image_seg, icn from profile")
def bin_profile(w):
    seg = F.when(F.col("image_seg") < -1e9, F.col("image_seg")).otherwise(F.bround("image_seg", 6))
    return _profile(w).select("cell", "chrom", F.col("bin_idx").cast("long").alias("bin_idx"), *six("image_orig"), seg.alias("image_seg"), "icn")


@query(TILES + """select cell, chrom, bin_idx, cast(greatest(0.0, least(7.0, icn)) as int) shown, cast(chrom_rank % 2 as int) parity, clone from profile join chroms using (chrom) join clones using (cell)""")
def heatmap(w):
    return views.heatmap(_profile(w), w.bins(), w.inputs.clones()).withColumn("bin_idx", F.col("bin_idx").cast("long"))


@query(TILES + """, shown as (select cell, bin_idx, greatest(0.0, least(7.0, icn)) s from profile)
select a.cell cell_a, b.cell cell_b, round_even(sqrt(sum((a.s - b.s) * (a.s - b.s))), 6) distance from shown a join shown b on a.bin_idx = b.bin_idx and a.cell < b.cell group by all""")
def cell_distances(w):
    return views.cell_distances(views.heatmap(_profile(w), w.bins())).select("cell_a", "cell_b", *six("distance"))


@query("""select chrom, n n_bins, total, cast(round_even(total - n + n / 2, 0) as bigint) middle from (select chrom, n, cast(sum(n) over (order by chrom_rank) as bigint) total from (select chrom, chrom_rank, count(*) n from bins group by all))""")
def chromosome_borders(w):
    return views.chromosome_borders(w.bins())




def sam_lines(w) -> DataFrame:
    """SAM-like lines of the mapped reads: some without a barcode tag, some with two."""
    r = w.inputs.reads().where("pos is not null")
    code = lambda n: F.concat(F.lit("CB:Z:BC"), F.lpad(n.cast("string"), 3, "0"), F.lit("-1"))
    tags = F.when(F.col("pos") % 7 == 0, F.lit("NM:i:0")).when(F.col("pos") % 11 == 0, F.concat_ws("\t", F.lit("NM:i:1"), code(F.col("pos") % 60), code((F.col("pos") + 1) % 60))).otherwise(F.concat_ws("\t", code(F.col("pos") % 60), F.lit("NM:i:0")))
    fixed = ["r", F.col("flag").cast("string"), "chrom", F.col("pos").cast("string"), F.col("mapq").cast("string"), "100M", "*", "0", "0"]
    columns = [F.lit(c) if isinstance(c, str) and c != "chrom" else F.col(c) if isinstance(c, str) else c for c in fixed]
    return r.select(F.concat_ws("\t", *columns, F.expr("repeat('A', qwidth)"), F.lit("*"), tags).alias("line"))


def listed_barcodes(w) -> DataFrame:
    return w.spark.range(50).select(F.concat(F.lit("BC"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-1")).alias("barcode"))


DEMUX = """, chosen as (select pos, case when pos % 7 = 0 then null when pos % 11 = 0 then (case when least(pos % 60, (pos + 1) % 60) < 50 then least(pos % 60, (pos + 1) % 60) end)
  when pos % 60 < 50 then pos % 60 end k from reads where pos is not null)
"""


@query(DEMUX + "select 'BC' || lpad(cast(k as varchar), 3, '0') barcode_dir, 'BC' || lpad(cast(k as varchar), 3, '0') || '-1' barcode, count(*) n from chosen where k is not null group by all")
def demultiplexed(w):
    return reads_source.demultiplex(sam_lines(w), listed_barcodes(w)).groupBy("barcode_dir", "barcode").agg(F.count("*").alias("n"))


@query(DEMUX + "select count(*) total, count(k) kept, round_even(count(k) / count(*), 6) fraction from chosen")
def demux_summary(w):
    return reads_source.demux_summary(reads_source.with_barcode(sam_lines(w), listed_barcodes(w))).select("total", "kept", *six("fraction"))


@query("select chrom, count(*) n, sum(pos) sum_pos, sum(mapq) sum_mapq, sum(qwidth) sum_qwidth, sum(flag) sum_flag from reads where pos is not null group by chrom")
def parsed_sam(w):
    r = reads_source.parse_sam(sam_lines(w))
    return r.groupBy("chrom").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in ("pos", "mapq", "qwidth", "flag")))


@query("""select chrom, "start", "end" from mask union all select chrom, "start" + 500 "start", "end" + 400 "end" from mask""")
def mask_regions(w):
    m = w.inputs.mask()
    gaps = m.select(F.lit(1).alias("id"), "chrom", (F.col("start") + 500).alias("start"), (F.col("end") + 400).alias("end"))
    return reads_source.mask_table("hg19", m, gaps)


@query("""select cell, bin_idx, case when v = 0 then 0.0 else round_even(round_even(v * pow(10.0, 2 - floor(log10(abs(v)))), 0) / pow(10.0, 2 - floor(log10(abs(v)))), 9) end v from (select cell, bin_idx, "count" / yhat v from fit)""")
def three_digits(w):
    v = F.col("count") / F.col("yhat")
    return w.expected().select("cell", F.col("bin_idx").cast("long").alias("bin_idx"), F.bround(signif(v), 9).alias("v"))


@query("""select cell, bin_idx, round_even(greatest(v, (select quantile_cont(v, 0.005) from (select "count" / yhat + bin_idx * 1e-6 v from fit))), 6) v from (select cell, bin_idx, "count" / yhat + bin_idx * 1e-6 v from fit)""")
def floored_by_quantile(w):
    rows = w.expected().select("cell", F.col("bin_idx").cast("long").alias("bin_idx"), (F.col("count") / F.col("yhat") + F.col("bin_idx") * 1e-6).alias("v"))
    rows = stored(rows, "ratios")
    return rows.select("cell", "bin_idx", F.bround(F.greatest("v", F.lit(low_quantile(rows, "v"))), 6).alias("v"))


@query("""select bin_idx, round_even(case when m > 0 then m else (select min(m) from (select median("count" / yhat) m from fit join clones using (cell) where clone = 'normal' group by bin_idx) where m > 0) end, 6) beta
from (select bin_idx, median("count" / yhat) m from fit join clones using (cell) where clone = 'normal' group by bin_idx)""")
def bin_bias(w):
    from ..operators.firstpass import bin_bias as bias

    fit = w.expected().join(F.broadcast(w.inputs.clones().where("clone = 'normal'").select("cell")), "cell", "left_semi")
    return bias(fit.withColumn("ratio", F.col("count") / F.col("yhat"))).select(F.col("bin_idx").cast("long").alias("bin_idx"), *six("beta"))


@query(""", scored as (select "count" y, yhat * (case when clone = 'normal' then 2 else 2.5 end) / 2 m from fit join clones using (cell))
select round_even(2 * sum(y * ln(greatest(m, 1)) - m) - 2 * 157 * 2, 3) aic, round_even(2 * sum(y * ln(greatest(m, 1)) - m) - 157 * 2 * ln(count(*)), 3) bic, round_even(sum((y - m) * (y - m)) / count(*), 6) rss from scored""")
def model_scores(w):
    from ..operators.latent import model_scores as scores

    rows = w.expected().join(F.broadcast(w.inputs.clones()), "cell").withColumn("alpha", F.when(F.col("clone") == "normal", 2.0).otherwise(2.5))
    return scores(rows, 2).select(F.bround("aic", 3).alias("aic"), F.bround("bic", 3).alias("bic"), F.bround("rss", 6).alias("rss"))


def _controlled(w):
    """Depth and bins after quality control, with normal cells and first-pass fit."""
    from ..operators import firstpass

    out = w.quality_controlled()
    depth = stored(out["depth"], "depth")
    normal = stored(gini.classified(gini.gini(depth)).where("is_normal"), "normal")
    return depth, out["bins"], normal, stored(firstpass.normalise_first(depth, out["bins"], normal), "first-pass")


@query()
def first_pass(w):
    """Expected depth of the first pass, per cell and bin."""
    return _controlled(w)[3].select("cell", "bin_idx", "count", "yhat", "fgc", "beta", "lib_size")


@query()
def segmentation_starts(w):
    placed = segment.with_positions(w.expected(), w.bins())
    return ploidy.segment_starts(ploidy.normalised_ratio(placed))


def _cells(w, depth, normal, fit, bins):
    """Cells with is_normal, ploidy and clone."""
    ploidies = ploidy.initialise(segment.with_positions(fit.select("cell", "bin_idx", "count", "yhat"), bins))
    return depth.select("cell").distinct().join(ploidies, "cell").join(w.inputs.clones(), "cell").join(normal.select("cell", F.lit(True).alias("is_normal")), "cell", "left").withColumn("is_normal", F.coalesce("is_normal", F.lit(False)))


def _normalised(w, ks, states, by_clone=False):
    from ..operators import latent

    depth, bins, normal, fit = _controlled(w)
    cells = stored(_cells(w, depth, normal, fit, bins), "cells")
    beta = fit.groupBy("bin_idx").agg(F.first("beta").alias("beta")).orderBy("bin_idx").toPandas()["beta"].to_numpy(float)
    return latent.normalise(depth, bins, cells, beta, ks, states, min_count=1, by_clone=by_clone), bins


@query()
def estimated_ploidy(w):
    depth, bins, normal, fit = _controlled(w)
    return _cells(w, depth, normal, fit, bins)


def _em_ready(w):
    """Cells packed for the copy states of the first pass, GC and bins."""
    from ..operators import em, firstpass

    depth, bins, normal, fit = _controlled(w)
    cells = _cells(w, depth, normal, fit, bins)
    packed = firstpass.packed(fit.withColumn("offset", F.col("lib_size") * F.col("beta")).withColumn("ratio", F.col("count") / (F.col("lib_size") * F.col("beta"))), "count", "ratio", "offset")
    gc = firstpass.gc_of(bins)
    return em.initial_alpha(packed.join(F.broadcast(cells.select("cell", "is_normal", "ploidy")), "cell"), gc), gc, bins


@query()
def em_diagnostics(w):
    """Scores by cell and number of copy states."""
    from ..operators import em

    ready, gc, _ = _em_ready(w)
    return em.diagnostics(ready, gc, [1, 2, 3, 4, 5], 1).select("cell", "t", "loglik", "bic", "best")


@query()
def em_curves(w):
    """What the diagnostic plots draw: GC, ratio, fitted curve and state of each bin, by cell and number of copy states."""
    from ..operators import em

    ready, gc, bins = _em_ready(w)
    ready = stored(ready, "ready")
    return em.curve_points(em.diagnostics(ready, gc, [1, 2, 3], 1), ready, bins)


@query()
def normalised(w):
    """Fit with one latent factor and copy states."""
    return _normalised(w, [1], [1, 2, 3, 4, 5])[0]["fit"]


@query()
def normalised_by_clone(w):
    return _normalised(w, [1], [1, 2, 3, 4, 5], by_clone=True)[0]["fit"]


@query()
def factor_scores(w):
    return _normalised(w, [1, 2], [1, 2, 3, 4])[0]["scores"]


@query()
def copy_number_calls(w):
    """The whole chain: reads to shared segments and integer copy numbers, with the number of factors that the scores choose."""
    from ..operators import latent

    out, bins = _normalised(w, [1, 2], [1, 2, 3, 4, 5])
    return segment.segment_genome(latent.best_fit(out).select("cell", "bin_idx", "count", "yhat"), bins)["calls"]


@query()
def pooled_segments(w):
    return segment.segment_genome(w.expected(), w.bins())["segments"]


@query()
def nested_segments(w):
    return segment.segment_genome(w.expected(), w.bins(), max_ns=2)["segments"]
