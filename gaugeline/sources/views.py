"""Views: directories laid out year=YYYY/month=MM/day=DD/file, found through the file system that Spark uses."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

MAX_DEPTH = 5
PARTITION = r"^(.*?)/year=([0-9]{4})/month=([0-9]{2})/day=([0-9]{2})/(.+)$"
MARKER_SUFFIX = ".marker"


class ViewError(ValueError):
    """A directory that isn't a view: empty, too deep, or with files outside the layout."""


@dataclass(frozen=True)
class ViewFile:
    view: str
    date: str
    part: str

    @property
    def path(self) -> str:
        y, m, d = self.date.split("-")
        return f"{self.view}/year={y}/month={m}/day={d}/{self.part}"


@dataclass(frozen=True)
class FileStatus:
    path: str
    size: int
    regular: bool


def parse_view_file(path: str) -> ViewFile | None:
    """The first partition in the path counts; the rest may have directories of its own."""
    m = re.match(PARTITION, path, re.S)
    return ViewFile(m[1], f"{m[2]}-{m[3]}-{m[4]}", m[5]) if m else None


def without_view(view: str, path: str) -> str | None:
    """The path below the view's root; null for one that isn't below it."""
    root = view.rstrip("/") + "/"
    return path[len(root) :] if path.startswith(root) and len(path) > len(root) else None


def join_folders(parts: list[str]) -> str:
    """Folders and a name as one path; empty parts and slashes at the seams fall away, a leading slash stays."""
    kept = [p for p in parts if p.strip("/")]
    lead = "/" if kept and parts[0].startswith("/") else ""
    return lead + "/".join(p.strip("/") for p in kept)


def partition_date(path: Column) -> Column:
    """The date in a file's path, null outside the layout."""
    return F.try_to_date(F.concat_ws("-", *[F.nullif(F.regexp_extract(path, PARTITION, i), F.lit("")) for i in (2, 3, 4)]), "yyyy-MM-dd")


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(status) -> str:
    """A path without the scheme of the local file system."""
    text = status.getPath().toString()
    return re.sub(r"^file:/+", "/", text)


def walk(spark: SparkSession, root: str, include_dot_files: bool = False, depth: int = MAX_DEPTH) -> list[str]:
    """Files below a directory.  Directories that start with . or _ are passed over, files that start with _ always, with . unless asked for; links are neither."""
    fs, p = _file_system(spark, root)
    found: list[str] = []

    def visit(path, left: int) -> None:
        for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if _is_link(_plain(status)):
                continue
            if status.isDirectory():
                if not name.startswith((".", "_")):
                    if left == 0:
                        raise ViewError(f"maximum depth exceeded at {_plain(status)}")
                    visit(status.getPath(), left - 1)
            elif not name.startswith("_") and (include_dot_files or not name.startswith(".")):
                found.append(_plain(status))

    visit(p, depth)
    return found


def _is_link(path: str) -> bool:
    """Links exist on local file systems only."""
    import os

    return "://" not in path and os.path.islink(path)


def traverse(spark: SparkSession, view: str, include_dot_files: bool = False) -> list[ViewFile]:
    """All files of a view; an error if there are none or some aren't in the layout."""
    view = view.rstrip("/")
    files = walk(spark, view, include_dot_files)
    parsed = [parse_view_file(f) for f in files]
    stray = [f for f, v in zip(files, parsed, strict=True) if v is None]
    if stray:
        raise ViewError("files outside the layout: " + ", ".join(stray))
    if not parsed:
        raise ViewError(f"no files in {view}")
    return parsed


def status(spark: SparkSession, path: str) -> FileStatus:
    """Size and kind; a link isn't a regular file."""
    fs, p = _file_system(spark, path)
    s = fs.getFileStatus(p)
    return FileStatus(path, int(s.getLen()), bool(s.isFile()) and not _is_link(path))


def remove_empty(spark: SparkSession, view: str) -> None:
    """Files without a byte go from a view that Spark wrote; if no file has any, the first stays.

    Spark writes a file for its first task even if that has no rows, as where a table's first split has no row group;
    a check takes an empty file for a failed delivery.
    """
    files = walk(spark, view)
    full = {p for p in files if status(spark, p).size}
    for path in (p for p in files[not full :] if p not in full):
        fs, p = _file_system(spark, path)
        fs.delete(p, False)


def file_marker_path(path: str) -> str:
    """Where a file's marker goes: beside it, with a name that views pass over."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/_{name}{MARKER_SUFFIX}"


def marked_file(path: str) -> str | None:
    """The file that a marker is about."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/{name[1 : -len(MARKER_SUFFIX)]}" if name.startswith("_") and name.endswith(MARKER_SUFFIX) and len(name) > 1 + len(MARKER_SUFFIX) else None


def view_marker_path(base: str, view: str, dates: tuple[str, str] | None, day: str, run_id: str) -> str:
    span = f"{dates[0]}_{dates[1]}" if dates else "no-dates"
    return f"{base}/_markers/view/{view.strip('/')}/{span}/{day}/{run_id}{MARKER_SUFFIX}"
