"""The whole run as one plan: which file goes where, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import names as N
from ..model import BLURRY, DUPLICATES, LIVE, NO_DATE, SCREENSHOTS, SKIPPED_DEST, SKIPPED_SOURCE, TAG_BLUR, TAG_DUPLICATE, TAG_SCREENSHOT, TAG_SORT, Options
from ..operators.content import Reader, content_marks
from ..operators.dates import resolve
from ..operators.dedup import destination_duplicates, source_duplicates_tiered
from ..operators.history import resumed
from ..operators.naming import sequence_names, unique_names
from ..operators.pairs import live_pairs
from ..operators.store import stored


@dataclass(frozen=True)
class Catalog:
    """What a plan reads. All but files may be absent.

    files: path, length, mtime. digests: path, partial, full. dst: path, length (and partial, full if existing
    files are skipped). history: src, mtime, size, dest. sidecars: path, body. exif: path and its fields.
    sharpness: path, score. locations: path, location. reader: reads contents where sizes meet, in place of digests.
    filed: path, length of targets given earlier in the same run, there or not. seen: path, length of files that were filed then, at
    the path where their bytes are now.
    """

    files: DataFrame
    digests: DataFrame | None = None
    dst: DataFrame | None = None
    history: DataFrame | None = None
    sidecars: DataFrame | None = None
    exif: DataFrame | None = None
    sharpness: DataFrame | None = None
    locations: DataFrame | None = None
    reader: Reader | None = None
    filed: DataFrame | None = None
    seen: DataFrame | None = None

    def targets(self) -> DataFrame | None:
        """path of what the destination holds or will hold."""
        held = [x.select("path") for x in (self.dst, self.filed) if x is not None]
        return held[0].unionByName(held[1]) if len(held) == 2 else held[0] if held else None


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(False))


def routed(catalog: Catalog, options: Options) -> DataFrame:
    """files with outcome, tag, target_dir, dest: the first of these that holds decides.

    resumed, junk, screenshot, unsupported, dest_dupe, source_dupe (filed under _Duplicates when moving),
    blurred, dated (live pairs under _LivePhotos), undated. Steps that an option turns off are not planned.
    Copies are sought only among files that came so far, in path order.
    """
    files = N.with_name_parts(catalog.files).withColumn("length", F.coalesce("length", F.lit(0).cast("bigint")))
    if not options.strict_parity:
        # a target inside the source holds what was filed before; a source inside the target is all to be filed
        root, source = (F.concat(N.normalised(F.lit(at or "")), F.lit("/")) for at in (options.dst_root, options.src_root))
        files = files.where(F.startswith(source, root) | ~F.startswith(N.normalised(F.col("path")), root))
    if options.resume_enabled and catalog.history is not None:
        there = catalog.targets()
        files = resumed(files, catalog.history, there if there is not None else F.lit(False), options.strict_parity)
    else:
        files = _flag(files, "is_resumed")
    files = files.withColumns({"is_junk": N.is_junk(F.col("ext")), "is_screenshot": N.is_screenshot(F.col("name"))})
    files = stored(files)
    media = files.where(~F.col("is_resumed") & ~F.col("is_junk") & ~F.col("is_screenshot") & F.col("media").isNotNull()).select("path", "length")

    if catalog.reader is not None:
        marks = content_marks(media, catalog.dst if options.skip_existing else None, catalog.reader, catalog.seen, options.strict_parity)
    else:
        marks = _marks(media, catalog, options)
    files = stored(files.join(marks, "path", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_dst", "is_dup")}))

    if options.blur_check_enabled and catalog.sharpness is not None:
        files = files.join(catalog.sharpness.select("path", "score"), "path", "left").withColumn("is_blurred", F.coalesce((F.col("media") == "photo") & (F.col("score") < options.blur_threshold), F.lit(False)))
    else:
        files = _flag(files, "is_blurred").withColumn("score", F.lit(None).cast("double"))
    files = live_pairs(resolve(files, options.as_of, catalog.sidecars, catalog.exif, options.sidecar_decides), options.ignore_case)
    if options.gps_enabled and catalog.locations is not None:
        files = files.join(catalog.locations.select("path", "location"), "path", "left")
    else:
        files = files.withColumn("location", F.lit(None).cast("string"))

    moving = options.mode == "move"
    kind = (
        F.when(F.col("is_resumed"), "resumed")
        .when(F.col("is_junk"), "junk")
        .when(F.col("is_screenshot"), "screenshot")
        .when(F.col("media").isNull(), "unsupported")
        .when(F.col("in_dst"), "dest_dupe")
        .when(F.col("is_dup"), "duplicate" if moving else "source_dupe")
        .when(F.col("is_blurred"), "blurred")
        .when(F.col("date").isNotNull(), "dated")
        .otherwise("undated")
    )
    files = files.withColumn("route", kind)
    route = F.col("route")
    kind_dir = F.when(F.col("is_live"), LIVE).when(F.col("media") == "photo", "Photos").otherwise("Videos")
    sub = F.when(route == "screenshot", SCREENSHOTS).when(route == "duplicate", DUPLICATES).when(route == "blurred", BLURRY).when(route == "undated", NO_DATE)
    sub = F.coalesce(sub, F.when(route == "dated", F.concat_ws("/", kind_dir, D.month(F.col("date")), "location")))
    tag = F.when(route == "screenshot", TAG_SCREENSHOT).when(route == "duplicate", TAG_DUPLICATE).when(route == "blurred", F.concat(F.lit(f"{TAG_BLUR}("), F.col("score").cast("bigint").cast("string"), F.lit(")"))).otherwise(TAG_SORT)
    files = files.withColumns({"target_dir": F.concat(F.lit(options.dst_root.rstrip("/") + "/"), sub), "tag": F.when(sub.isNotNull(), tag), "outcome": F.when(sub.isNotNull(), "filed").otherwise(route), "error": F.lit(None).cast("string")})
    return with_targets(stored(files), catalog, options)


def _marks(media: DataFrame, catalog: Catalog, options: Options) -> DataFrame:
    """path, in_dst, is_dup from a table of digests: copies of the destination first, and those left among each other."""
    marks = media.withColumn("in_dst", F.lit(False))
    if options.skip_existing and catalog.dst is not None and catalog.digests is not None and "full" in catalog.dst.columns:
        there = media.join(catalog.digests.select("path", "partial", "full"), "path", "left")
        marks = destination_duplicates(there, catalog.dst, ["partial", "full"], options.strict_parity).select("path", "length", "in_dst")
    if catalog.digests is None:
        return marks.select("path", "in_dst", F.lit(False).alias("is_dup"))
    own = source_duplicates_tiered(marks.where(~F.col("in_dst")).select("path", "length"), catalog.digests, "path", options.strict_parity).select("path", F.lit(False).alias("in_dst"), "is_dup")
    return own.unionByName(marks.where("in_dst").select("path", "in_dst", F.lit(False).alias("is_dup")))


def with_targets(files: DataFrame, catalog: Catalog, options: Options) -> DataFrame:
    """files with dest: the target path of those that are filed."""
    filed = files.where(F.col("outcome") == "filed")
    numbered = F.lit(options.rename_enabled) & (F.col("route") == "dated") & ~F.col("is_live")
    existing = catalog.targets()
    names = unique_names(filed.where(~numbered).select("path", "target_dir", "name"), existing).select("path", "target_dir", "target_name")
    if options.rename_enabled:
        own = filed.where(numbered).select("path", "target_dir", "ext", D.day_prefix(F.col("date")).alias("prefix"))
        names = names.unionByName(sequence_names(own, existing).select("path", "target_dir", "target_name"))
    dest = names.select(F.col("path").alias("__path"), F.concat("target_dir", F.lit("/"), "target_name").alias("dest"))
    return files.join(dest, F.col("path") == F.col("__path"), "left").drop("__path")


def history_updates(plan: DataFrame, options: Options) -> DataFrame:
    """src, mtime, size, dest of this run: none in a dry run or without resume. Strict parity loses those of moved files."""
    moved = F.lit(options.mode == "move" and options.strict_parity) & (F.col("outcome") == "filed")
    dest = F.when(F.col("outcome") == "filed", F.col("dest")).when(F.col("outcome") == "dest_dupe", SKIPPED_DEST).when(F.col("outcome") == "source_dupe", SKIPPED_SOURCE)
    rows = plan.select(F.col("path").alias("src"), "mtime", F.col("length").alias("size"), dest.alias("dest"), moved.alias("__lost"))
    keep = F.lit(options.resume_enabled and not options.dry_run)
    return rows.where(keep & F.col("dest").isNotNull() & ~F.col("__lost")).drop("__lost")


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """path of the directories (path) below which no file (path) lies; the root is not among dirs."""
    parts = F.split("path", "/")
    held = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    return dirs.join(held, "path", "left_anti")
