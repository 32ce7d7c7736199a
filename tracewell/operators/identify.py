"""Format identification: what to read of an image, well-known magics in its head, and the policy over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTOR, WINDOW, SWEEP = 512, 1024 * 1024, 32

#: Place, bytes in hex and meaning of magics that explain an unknown image.
MAGICS = [
    (510, "55AA", "MBR / boot-sector signature"),
    (512, "4546492050415254", "GPT partition table header"),
    (3, "4E54465320202020", "NTFS boot sector"),
    (3, "4558464154202020", "exFAT boot sector"),
    (82, "4641543332202020", "FAT32 boot sector"),
    (54, "46415431", "FAT12/FAT16 boot sector"),
    (1080, "53EF", "ext2/3/4 superblock magic"),
    (0, "58465342", "XFS superblock"),
]


def probe_plan(images: DataFrame, windows: int = SWEEP, window: int = WINDOW) -> DataFrame:
    """evidence_id, region, offset, length: the first sector, head, tail, and evenly spaced windows between that neither
    overlap nor pass the middle's end. images: evidence_id, size."""
    size = F.col("size")
    tail = F.greatest(F.lit(0), size - window)
    head_end = F.least(F.lit(window), size)
    region = lambda name, offset, length: F.struct(F.lit(name).alias("region"), offset.cast("long").alias("offset"), length.cast("long").alias("length"))
    span = tail - head_end
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: head_end + F.floor(i * (span / F.lit(float(windows)))).cast("long"))
    # evenly spaced windows overlap all or none, but for the last, which is cut at the middle's end
    take = F.aggregate(
        starts,
        F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, s: F.when(s >= acc.end, F.struct(F.least(s + window, tail).cast("long").alias("end"), F.concat(acc.kept, F.array(s)).alias("kept"))).otherwise(acc),
        lambda acc: acc.kept,
    )
    sweep = F.when(span > 0, F.transform(take, lambda s: region("sweep", s, F.least(F.lit(window), tail - s)))).otherwise(F.array().cast("array<struct<region:string,offset:bigint,length:bigint>>"))
    first = [region("lba0", F.lit(0), F.least(F.lit(SECTOR), size)), region("head", F.lit(0), head_end), region("tail", tail, size - tail)]
    regions = images.select("evidence_id", F.explode(F.concat(F.array(*first), sweep)).alias("r")).select("evidence_id", "r.*")
    return regions.where("length > 0")


def magic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAGICS, "offset int, magic string, description string")


def observations(heads: DataFrame) -> DataFrame:
    """evidence_id, offset, description of each magic that stands in the first 4 KiB. heads: evidence_id, head (binary)."""
    tables = F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(m).alias("magic"), F.lit(d).alias("description")) for o, m, d in MAGICS]))
    rows = heads.select("evidence_id", "head", tables.alias("t"))
    stands = F.hex(F.substring("head", F.col("t.offset") + 1, F.length("t.magic") / 2)) == F.col("t.magic")
    return rows.where(stands).select("evidence_id", "t.offset", "t.description")


def support(status: Column, family: Column, parses: Column) -> Column:
    """pending_selection or none without a family, else parse or carve_only."""
    return F.when(family.isNull(), F.when(status == "ambiguous", "pending_selection").otherwise("none")).when(parses, "parse").otherwise("carve_only")


def identify(images: DataFrame, candidates: DataFrame) -> DataFrame:
    """evidence_id, status, family, support, candidates: unknown without a candidate, identified with one, ambiguous
    with more, and then none is selected. candidates: evidence_id, family, confidence, layout, parses."""
    entry = F.struct((-F.col("confidence")).alias("order"), "family", "confidence", "layout", "parses")
    listed = candidates.groupBy("evidence_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    rows = images.select("evidence_id").join(listed, "evidence_id", "left")
    n = F.coalesce(F.size("c"), F.lit(0))
    status = F.when(n <= 0, "unknown").when(n == 1, "identified").otherwise("ambiguous")
    rows = rows.withColumn("status", status).withColumn("one", F.when(F.col("status") == "identified", F.col("c")[0]))
    listed = F.coalesce(F.transform("c", lambda x: F.struct(x.family, x.confidence)), F.array().cast("array<struct<family:string,confidence:double>>"))
    return rows.select("evidence_id", "status", F.col("one.family").alias("family"), support(F.col("status"), F.col("one.family"), F.col("one.parses")).alias("support"), listed.alias("candidates"))


def select_family(identified: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """An operator's choice (evidence_id, family) among the candidates of each evidence; another choice raises."""
    listed = candidates.select("evidence_id", "family", F.lit(True).alias("known"), "parses")
    picked = choices.join(listed, ["evidence_id", "family"], "left")
    checked = F.when(F.col("known").isNull(), F.raise_error("the family chosen is not a candidate").cast("string")).otherwise(F.col("family"))
    picked = picked.select("evidence_id", checked.alias("chosen"), F.col("parses").alias("chosen_parses"))
    rows = identified.join(picked, "evidence_id", "left")
    family = F.coalesce("chosen", "family")
    status = F.when(F.col("chosen").isNotNull(), "identified").otherwise(F.col("status"))
    return rows.select("evidence_id", status.alias("status"), family.alias("family"), F.when(F.col("chosen").isNotNull(), support(F.lit("identified"), F.col("chosen"), F.col("chosen_parses"))).otherwise(F.col("support")).alias("support"), "candidates")
