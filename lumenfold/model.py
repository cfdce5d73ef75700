"""Schemas, fixed values and options of the file catalogue."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Extensions and name keywords by which files are classed.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".bmp", ".tiff", ".raw", ".arw", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".3gp", ".m4v")
JUNK_EXTENSIONS = (".json", ".ini", ".db", ".html", ".txt", ".tmp", ".url")
SCREENSHOT_KEYWORDS = ("screenshot", "screen shot", "captura", "螢幕擷取", "截圖", "snapshot")
# Siblings that may lend a date, best first.
SIBLING_EXTENSIONS = (".heic", ".HEIC", ".jpg", ".JPG", ".jpeg", ".JPEG")

# Folders, and tags of actions.
SCREENSHOTS, DUPLICATES, BLURRY, NO_DATE, LIVE = "_Screenshots", "_Duplicates", "_Blurry", "No_Date", "_LivePhotos"
TAG_SORT, TAG_SCREENSHOT, TAG_DUPLICATE, TAG_BLUR = "整理", "截圖", "重複", "模糊"
UNKNOWN_COUNTRY, UNKNOWN_CITY = "未知國家", "未知城市"

#: History values of files that were not filed. Strict parity accepts only the last.
SKIPPED_DEST, SKIPPED_SOURCE, SKIPPED_ANY = "SKIPPED_DEST_DUPE", "SKIPPED_SRC_DUPE", "SKIPPED_DUPLICATE"

FILES = "path string, length bigint, mtime double"
HISTORY = "src string, mtime double, size bigint, dest string"
HISTORY_ENTRY = "map<string, struct<mtime: double, size: bigint, dest: string>>"
PREVIEW = ("Source File", "Action", "Destination File", "Note")

#: Sizes in bytes from which a file is compared by three samples first, and of a sample.
SMALL_FILE, SAMPLE = 20_480, 4096
#: Seconds by which modification times may differ, and score below which a picture is blurred.
MTIME_TOLERANCE, BLUR_THRESHOLD = 2.0, 100.0
#: Days by which a date may lie after as_of.
FUTURE_DAYS = 30


@dataclass(frozen=True)
class Options:
    """What one run does. as_of stands for the present, so that a plan can be repeated."""

    src_root: str
    dst_root: str
    mode: str = "copy"
    rename_enabled: bool = False
    gps_enabled: bool = False
    resume_enabled: bool = False
    blur_check_enabled: bool = False
    skip_existing: bool = False
    clean_empty: bool = False
    dry_run: bool = False
    #: Keep the defects of the original behaviour: only SKIPPED_DUPLICATE resumes, unreadable files of one
    #: size are duplicates, the destination is scanned as source when it lies within it.
    strict_parity: bool = False
    ignore_case: bool = False
    #: A sidecar's date that is not valid leaves a file without one of its own; else the fields and the name are asked next.
    sidecar_decides: bool = False
    blur_threshold: float = BLUR_THRESHOLD
    as_of: dt.datetime = field(default_factory=dt.datetime.now)

    def __post_init__(self) -> None:
        if self.mode not in ("copy", "move"):
            raise ValueError("mode must be copy or move")
