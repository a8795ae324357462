"""Folder listings made by tasks, for folders of more files than a driver should hold.

Each level of folders is a table; tasks list the folders of one level and write what they find, files and folders, as
the next table. After ``LEVELS`` levels the folders left are listed with all that is below them. The driver knows how many
levels there are, never a path.

Tasks open the file system through Arrow. Where Arrow has no file system for the scheme, or can't open it, Spark's own
scan gives the paths, which also never reach the driver's Python; files of zero length are missing then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.staging import stage

#: So many levels of folders are dealt out to tasks one by one.
LEVELS = 3
#: At most so many tasks list the folders of one level.
TASKS = 1_000
#: So many paths leave a task at once.
BATCH = 10_000

# Schemes of Spark's file systems and those that Arrow knows them by.
ARROW_SCHEMES = {
    "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs",
}
OBJECT_STORES = ("s3", "gs")
# Characters that a URI's path escapes.
ESCAPED = r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\x80-\U0010FFFF]|[\x80-\x9F]|\s"

_ENTRY = "folder string, path string, name string, size long, is_folder boolean"


def glob_pattern(glob: str) -> str:
    """A Java regular expression for a file name glob: ``*``, ``?``, ``[...]``, ``{a,b}`` and escapes."""
    out, depth, at = [], 0, 0
    while at < len(glob):
        char = glob[at]
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inside = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' + inside[1:] if inside[0] in '!^' else inside}]")
            at = end
        elif char == "{":
            out.append("(?:")
            depth += 1
        elif char == "}" and depth:
            out.append(")")
            depth -= 1
        elif char == "," and depth:
            out.append("|")
        else:
            if char == "\\" and at + 1 < len(glob):
                at += 1
                char = glob[at]
            out.append(char if char.isalnum() or char == "_" else f"\\x{{{ord(char):x}}}")
        at += 1
    return f"^(?s:{''.join(out)})$"


def _qualified(spark: SparkSession, base: str) -> tuple[str, str]:
    """Scheme and authority (``hdfs://host:1``, ``file:``) of a folder, and its plain path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    conf = spark._jsc.hadoopConfiguration()
    uri = path.getFileSystem(conf).makeQualified(path).toUri()
    authority = uri.getAuthority()
    return f"{uri.getScheme()}:" + (f"//{authority}" if authority else ""), uri.getPath().rstrip("/") or "/"


def _arrow_place(root: str) -> tuple[str, str]:
    """What Arrow opens the file system by, and what its paths have before Spark's (the bucket of an object store)."""
    scheme, _, authority = root.partition(":")
    kind = ARROW_SCHEMES[scheme]
    return f"{kind}:{authority or '//'}/", authority.strip("/") if kind in OBJECT_STORES else ""


def _lister(root: str, recursive: bool):
    """A function for mapInArrow: folders (plain paths) to their entries, in bounded batches.

    With ``recursive`` it goes on into the folders it finds, one after the other. It needs nothing of this package, so
    that it travels by value.
    """
    place, bucket = _arrow_place(root)
    size, escaped = BATCH, ESCAPED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import pyarrow as arrow
        from pyarrow import fs

        kinds = [arrow.string(), arrow.string(), arrow.string(), arrow.int64(), arrow.bool_()]
        to_escape = re.compile(escaped)

        def uri(path: str) -> str:
            return to_escape.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)

        def sent(found: list) -> pa.RecordBatch:
            columns = list(zip(*found))
            return arrow.RecordBatch.from_arrays(
                [arrow.array(c, k) for c, k in zip(columns, kinds)],
                names=["folder", "path", "name", "size", "is_folder"],
            )

        system, found = None, []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                if system is None:
                    system, _ = fs.FileSystem.from_uri(place)
                waiting = [folder]
                while waiting:
                    plain = f"{bucket}{waiting.pop()}"
                    for info in system.get_file_info(fs.FileSelector(plain)):
                        name = info.base_name
                        # As in Spark's scans: hidden names and files still being copied are not data.
                        if name.startswith(".") or (name.startswith("_") and "=" not in name):
                            continue
                        if name.endswith("._COPYING_"):
                            continue
                        path = info.path[len(bucket) :]
                        is_folder = info.type == fs.FileType.Directory
                        if is_folder and recursive:
                            waiting.append(path)
                            continue
                        found.append((path, root + uri(path), name, info.size or 0, is_folder))
                        if len(found) == size:
                            yield sent(found)
                            found = []
        if found:
            yield sent(found)

    return run


def _scanned(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """(path, size) of all files but empty ones, from Spark's scan without their content."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(base)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    )


def _opens(root: str, folder: str) -> bool:
    """Whether Arrow finds the folder; asked once on the driver, without listing it."""
    if root.partition(":")[0] not in ARROW_SCHEMES:
        return False
    place, bucket = _arrow_place(root)
    try:
        system, _ = pafs.FileSystem.from_uri(place)
        return system.get_file_info(f"{bucket}{folder}").type == pafs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def listed_files(spark: SparkSession, base: str, glob: str = "*", levels: int = LEVELS) -> DataFrame:
    """(path, size) of every file below ``base`` whose name fits ``glob``, as written tables.

    Paths are spelled as ``_metadata.file_path`` of a scan spells them. Hidden files and folders are left out, empty
    files are not. An empty folder gives no rows; a missing one raises. A task holds the entries of one folder at a time.
    """
    root, folder = _qualified(spark, base)
    if not _opens(root, folder):
        return stage(_scanned(spark, base, glob), "listing")
    fits = F.rlike("name", F.lit(glob_pattern(glob)))
    frontier = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("folder"))
    found = None
    for level in range(levels + 1):
        run = _lister(root, recursive=level == levels)
        entries = stage(frontier.mapInArrow(run, _ENTRY), "listing")
        files = entries.where(~F.col("is_folder") & fits).select("path", "size")
        found = files if found is None else found.union(files)
        below = entries.where("is_folder").select("folder")
        n_below = below.count()
        if not n_below:
            break
        frontier = below.repartition(min(TASKS, n_below), "folder")
    return found
