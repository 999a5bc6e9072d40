"""The analysis inputs derived from the order tables, in Spark and as SQL text.

Supplier groups stand for cells, part keys for genome positions, line numbers for chromosomes. `reads_cn` has
planted copy numbers: cells 03 to 09 have one copy on chr2 (bins 5 to 14), three on chr5, four on chr7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_CHROMS = 7
NORMAL_CELLS = 3


class Inputs:
    """All derived inputs of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.part = spark.read.parquet(f"{sf_dir}/part.parquet")
        self.lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def _size(self) -> DataFrame:
        return F.broadcast(self.part.agg((F.max("p_partkey") + 1).alias("n_part")))

    def chroms(self) -> DataFrame:
        c = F.col("id")
        rows = self.spark.range(1, N_CHROMS + 1).crossJoin(self._size())
        return rows.select(
            F.concat(F.lit("chr"), c.cast("string")).alias("chrom"), c.alias("chrom_rank"), (F.col("n_part") * 1000 + 137 * c).alias("len"), (F.col("n_part") * 50).alias("w")
        )

    def reads(self, planted: bool = True) -> DataFrame:
        li = self.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
        unmapped = F.col("l_orderkey") % 97 == 0
        flag = (
            F.lit(65) + F.when(unmapped, 4).otherwise(0) + F.when(F.col("l_orderkey") % 89 == 0, 512).otherwise(0)
            + F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 10 == 0), 1024).otherwise(0)
        )
        cno = F.col("l_suppkey") % 10
        reads = li.select(
            F.concat(F.lit("cell"), F.lpad(cno.cast("string"), 2, "0")).alias("cell"),
            F.when(~unmapped, F.concat(F.lit("chr"), F.col("l_linenumber").cast("string"))).alias("chrom"),
            F.when(~unmapped, F.col("l_partkey") * 1000 + 1 + (F.col("l_orderkey") * 37) % 1000).alias("pos"),
            F.col("l_quantity").cast("int").alias("mapq"), F.lit(100).alias("qwidth"), flag.cast("int").alias("flag"), cno.alias("cno"), F.col("l_orderkey"),
        )
        if planted:
            w = F.col("n_part") * 50
            tumour = F.col("cno") >= NORMAL_CELLS
            lost = tumour & (F.col("chrom") == "chr2") & F.col("pos").between(5 * w + 1, 15 * w) & (F.col("l_orderkey") % 2 == 1)
            gained = (F.col("chrom") == "chr5") & (F.col("l_orderkey") % 2 == 0) | (F.col("chrom") == "chr7")
            copies = F.when(F.coalesce(lost, F.lit(False)), 0).when(F.coalesce(tumour & gained, F.lit(False)), 2).otherwise(1)
            reads = reads.crossJoin(self._size()).withColumn("copy_", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).drop("copy_", "n_part")
        return reads.drop("cno", "l_orderkey")

    def per_chrom(self, part: DataFrame) -> DataFrame:
        c = self.spark.range(1, N_CHROMS + 1).select(F.col("id").alias("c"))
        return part.crossJoin(F.broadcast(c)).withColumn("chrom", F.concat(F.lit("chr"), F.col("c").cast("string")))

    def mapp_track(self) -> DataFrame:
        rows = self.per_chrom(self.part.select("p_partkey").crossJoin(self._size()))
        low = F.floor(F.col("p_partkey") * 20 / F.col("n_part")) == (F.col("c") + 3) % 20
        score = F.when(low, F.lit(0.5)).otherwise(1.0 - (F.col("p_partkey") % 5) * 0.02)
        return rows.select("chrom", (F.col("p_partkey") * 1000 + 1).alias("start"), (F.col("p_partkey") * 1000 + 800).alias("end"), score.cast("double").alias("score"))

    def mask(self) -> DataFrame:
        rows = self.per_chrom(self.part.where("p_size = 50").select("p_partkey"))
        return rows.select("chrom", (F.col("p_partkey") * 1000 + 1).alias("start"), (F.col("p_partkey") * 1000 + 500).alias("end"))

    def seq_chunks(self) -> DataFrame:
        rows = self.per_chrom(self.part.select("p_partkey", "p_size").crossJoin(self._size()))
        g = (F.lit(30) + F.floor(F.col("p_partkey") * 40 / F.col("n_part")) + F.col("p_size") % 5).cast("int")
        seq = F.concat(F.expr("repeat('G', g)"), F.expr("repeat('A', 90 - g)"), F.lit("N" * 10))
        return rows.withColumn("g", g).select("chrom", (F.col("p_partkey") * 1000 + 1).alias("start"), seq.alias("seq"))

    def clones(self) -> DataFrame:
        c = F.col("id")
        return self.spark.range(10).select(F.concat(F.lit("cell"), F.lpad(c.cast("string"), 2, "0")).alias("cell"), F.when(c < NORMAL_CELLS, "normal").otherwise("tumor1").alias("clone"))


#: The same inputs as common table expressions, for the queries' SQL.
SQL = """
np as (select max(p_partkey) + 1 n_part from part),
chroms as (select 'chr' || c chrom, c chrom_rank, n_part * 1000 + 137 * c len, n_part * 50 w from np, range(1, 8) t(c)),
bins as (select chrom, chrom_rank, b bin_no, b * w + 1 as "start", least((b + 1) * w, len) as "end", row_number() over (order by chrom_rank, b) bin_idx
  from (select *, unnest(range(0, (len - 1) // w + 1)) b from chroms)),
reads0 as (select 'cell' || lpad(cast(l_suppkey % 10 as varchar), 2, '0') cell, case when l_orderkey % 97 = 0 then null else 'chr' || l_linenumber end chrom,
  case when l_orderkey % 97 = 0 then null else l_partkey * 1000 + 1 + (l_orderkey * 37) % 1000 end pos, cast(l_quantity as int) mapq, 100 qwidth,
  65 + (case when l_orderkey % 97 = 0 then 4 else 0 end) + (case when l_orderkey % 89 = 0 then 512 else 0 end) + (case when l_returnflag = 'R' and l_orderkey % 10 = 0 then 1024 else 0 end) flag,
  l_suppkey % 10 cno, l_orderkey from lineitem),
reads as (with x as (select r.*, w from reads0 r, (select n_part * 50 w from np))
  select x.* exclude(w) from x where not coalesce(cno >= 3 and chrom = 'chr2' and pos between 5 * w + 1 and 15 * w and l_orderkey % 2 = 1, false)
  union all select x.* exclude(w) from x where cno >= 3 and chrom = 'chr5' and l_orderkey % 2 = 0
  union all select x.* exclude(w) from x where cno >= 3 and chrom = 'chr7'),
mapp_track as (select 'chr' || c chrom, p_partkey * 1000 + 1 as "start", p_partkey * 1000 + 800 as "end",
  cast(case when p_partkey * 20 // n_part = (c + 3) % 20 then 0.5 else 1.0 - (p_partkey % 5) * 0.02 end as double) score from part, np, range(1, 8) t(c)),
mask as (select 'chr' || c chrom, p_partkey * 1000 + 1 as "start", p_partkey * 1000 + 500 as "end" from part, range(1, 8) t(c) where p_size = 50),
seq_chunks as (select 'chr' || c chrom, p_partkey * 1000 + 1 as "start", repeat('G', cast(g as int)) || repeat('A', cast(90 - g as int)) || repeat('N', 10) seq
  from (select p_partkey, 30 + p_partkey * 40 // n_part + p_size % 5 g from part, np), range(1, 8) t(c)),
clones as (select 'cell' || lpad(cast(c as varchar), 2, '0') cell, case when c < 3 then 'normal' else 'tumor1' end clone from range(10) t(c))
"""
