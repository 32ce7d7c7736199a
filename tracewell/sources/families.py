"""Format families: what each can do with evidence, and one plan that joins identification with what the families give.

A family is a record of functions from evidence to rows. Nothing outside asks for a family by name: probing runs all of
them, and every later step runs each on the evidence that identification dealt to it. Evidence whose family is not
registered, or has no such step, comes back as a refused row with the reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import micros
from ..operators import carving, identify, reassembly
from . import evidence as sources
from . import formats


@dataclass(frozen=True)
class Evidence:
    """Images (evidence_id, path, size) and their windows (evidence_id, offset, bytes), with the size of a window's own
    part. Images of one read have their paths on a share that executors mount."""

    images: DataFrame
    windows: DataFrame
    chunk: int = carving.CHUNK

    def only(self, ids: DataFrame) -> Evidence:
        ids = ids.select("evidence_id").distinct()
        return replace(self, images=self.images.join(ids, "evidence_id", "left_semi"), windows=self.windows.join(ids, "evidence_id", "left_semi"))


CANDIDATES = ["evidence_id", "confidence", "layout", "parses"]
LAYOUT = ["evidence_id", "version", "parse_supported", "block_size", "index_extents", "log_extents", "notes"]
RECORDING = ["evidence_id", "tier", "confidence", "channel", "codec", "local_start_us", "local_end_us", "extents", "notes"]


@dataclass(frozen=True)
class Family:
    """probe: evidence -> CANDIDATES. layout: evidence -> LAYOUT. enumerate: (evidence, layouts, with freed entries) ->
    RECORDING. carve: (evidence, holes) -> RECORDING. frames: (evidence, pieces) -> frames in disjoint pieces. What a
    family cannot do is None."""

    name: str
    versions: tuple[str, ...]
    probe: Callable[[Evidence], DataFrame]
    layout: Callable[[Evidence], DataFrame] | None = None
    enumerate: Callable[[Evidence, DataFrame, bool], DataFrame] | None = None
    carve: Callable[[Evidence, DataFrame], DataFrame] | None = None
    frames: Callable[[Evidence, DataFrame], DataFrame] | None = None
    signatures: tuple[str, ...] = ()


FAMILIES: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Make a family known. A name is taken once; layouts without an enumeration, or signatures that nobody knows, are
    refused."""
    if family.name in FAMILIES:
        raise ValueError(f"a family named {family.name} is registered already")
    if (family.layout is None) != (family.enumerate is None):
        raise ValueError(f"{family.name}: a layout and an enumeration of recordings go together")
    if unknown := set(family.signatures) - set(formats.SIGNATURES):
        raise ValueError(f"{family.name}: no such signatures: {', '.join(sorted(unknown))}")
    FAMILIES[family.name] = family
    return family


def open_images(spark: SparkSession, paths: dict[str, str], chunk: int = carving.CHUNK, overlap: int = carving.OVERLAP) -> Evidence:
    """Evidence of the paths (by evidence_id), by kind of source: a folder is a set of files in one address space, a
    numbered part is the first of a split image, other files are raw images. A path that is not there raises; so do
    containers, which need a decoder that is not here."""
    parts = [sources.open_source(spark, path, name, chunk, overlap) for name, path in paths.items()]
    rows = [(name, path, size) for (name, path), (_, size) in zip(paths.items(), parts)]
    return Evidence(spark.createDataFrame(rows, "evidence_id string, path string, size long"), reduce(DataFrame.unionByName, [w for w, _ in parts]), chunk)


def probed(evidence: Evidence) -> DataFrame:
    """evidence_id, family, confidence, layout, parses: what every family says of every image."""
    return reduce(DataFrame.unionByName, [f.probe(evidence).select(*CANDIDATES).withColumn("family", F.lit(f.name)) for f in FAMILIES.values()])


def identified(evidence: Evidence) -> DataFrame:
    """See identify.identify; one candidate identifies, several never do."""
    return identify.identify(evidence.images, probed(evidence))


def _dealt(evidence: Evidence, known: DataFrame, step: str):
    """(family, its evidence) of the families that have a step; an image is a family's only if it is identified as that."""
    for f in FAMILIES.values():
        if getattr(f, step) is not None:
            yield f, evidence.only(known.where((F.col("status") == "identified") & (F.col("family") == f.name)))


def refused(known: DataFrame, step: str) -> DataFrame:
    """evidence_id, family, reason of the images that a step leaves out."""
    able = [name for name, f in FAMILIES.items() if getattr(f, step) is not None]
    listed = lambda names: F.col("family").isin(*names) if names else F.lit(False)
    reason = (
        F.when(F.col("status") != "identified", F.concat(F.lit("the format is "), F.col("status")))
        .when(F.col("family").isNull() | ~listed(list(FAMILIES)), F.concat(F.lit("no family is registered as "), F.coalesce("family", F.lit("null"))))
        .when(~listed(able), F.concat(F.lit("the family has no "), F.lit(step)))
        .when(F.lit(step == "layout") & (F.col("support") != "parse"), "its layout is not parsed: carving is left")
    )
    return known.select("evidence_id", "family", reason.alias("reason")).where("reason is not null")


def parsed(evidence: Evidence, known: DataFrame, orphans: bool = False) -> dict[str, DataFrame]:
    """layouts, recordings and refused of all images, each family's of its own images only. known: see identified."""
    layouts, recordings = [], []
    for f, own in _dealt(evidence, known.where("support = 'parse'"), "layout"):
        layout = f.layout(own)
        layouts.append(layout.select(*LAYOUT).withColumn("family", F.lit(f.name)))
        recordings.append(f.enumerate(own, layout, orphans).select(*RECORDING).withColumn("family", F.lit(f.name)))
    return {"layouts": reduce(DataFrame.unionByName, layouts), "recordings": reduce(DataFrame.unionByName, recordings), "refused": refused(known, "layout")}


def carved(evidence: Evidence, known: DataFrame, holes: DataFrame) -> dict[str, DataFrame]:
    """recordings and refused of all images: what is carved of each, by its own family. holes: unreadable ranges
    (evidence_id, offset, length)."""
    made = [f.carve(own, holes.join(own.images, "evidence_id", "left_semi")).select(*RECORDING).withColumn("family", F.lit(f.name)) for f, own in _dealt(evidence, known, "carve")]
    return {"recordings": reduce(DataFrame.unionByName, made), "refused": refused(known, "carve")}


# --- the two families -------------------------------------------------------------------
def _probe_frames(evidence: Evidence) -> DataFrame:
    plan = identify.probe_plan(evidence.images.select("evidence_id", "size"))
    looked = carving.in_regions(evidence.windows, plan, evidence.chunk)
    made = formats.export_probe(formats.frame_candidates(looked, evidence.chunk), plan)
    return made.select("evidence_id", "confidence", F.lit(None).cast("string").alias("layout"), F.lit(False).alias("parses"))


def _carve_frames(evidence: Evidence, holes: DataFrame) -> DataFrame:
    rows = reassembly.reassembled(evidence.windows, holes, evidence.chunk)
    extent = F.array(F.struct("offset", "length"))
    return rows.select("evidence_id", "tier", "confidence", "channel", "codec", F.col("start_us").alias("local_start_us"), F.col("end_us").alias("local_end_us"), extent.alias("extents"), "notes")


def _volume_layouts(evidence: Evidence) -> DataFrame:
    return formats.volume_layouts(formats.index_pages(evidence.images))


def _volume_recordings(evidence: Evidence, layouts: DataFrame, orphans: bool) -> DataFrame:
    rows = formats.volume_recordings(formats.index_pages(evidence.images), layouts, orphans)
    return rows.withColumns({"codec": F.lit("h264"), "local_start_us": micros(F.col("start_local")), "local_end_us": micros(F.col("end_local"))})


#: The families' names.
register(Family("dahua", ("DHAV",), _probe_frames, carve=_carve_frames, frames=lambda e, pieces: formats.frames_of_windows(e.windows, pieces, e.chunk), signatures=("frame",)))
register(
    Family(
        "hikvision", (formats.PARSED_VERSION,), lambda e: _volume_layouts(e).select("evidence_id", "confidence", F.col("version").alias("layout"), F.col("parse_supported").alias("parses")),
        layout=_volume_layouts, enumerate=_volume_recordings, frames=lambda e, pieces: formats.pack_frames(e.windows, pieces.select("evidence_id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length")), e.chunk), signatures=("pack",),
    )
)
