"""Database members of tar archives, as a Spark job.

Archives come as ``binaryFile`` rows, so they are read from any store that
Spark reads; one that exceeds a row is streamed.  A tar file has no index: one
archive is read by one task, member after member, many archives in parallel.
Rows leave in batches of bounded bytes.  What cannot be read is a row with its
error, never silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import DB_GLOB
from .streams import ROW_BYTES, bound_content, open_bytes, sha256_of, with_content

_COLUMNS = "archive string, member string, length long, {what}error string"
#: Bytes of members that a task holds before it passes them on.
BATCH_BYTES = 8 << 20


def list_archives(spark: SparkSession, root: str, glob: str = "*.tar", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Archives as (path, length, content); those beyond ``row_bytes`` without content, to be streamed from a store
    that Python opens as well."""
    bound_content(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))
    return with_content(files, row_bytes)


def _read_members(take, field: str | None, row_bytes: int = ROW_BYTES):
    """One row per database member; ``take`` turns its stream into the extra field.

    A member whose content does not fit a row is an error row.
    """
    names = ["archive", "member", "length", *([field] if field else []), "error"]

    def wanted(entry) -> bool:
        from fnmatch import fnmatchcase

        return entry.isreg() and fnmatchcase(entry.name.rsplit("/", 1)[-1], DB_GLOB)

    def rows_of(path, content):
        import tarfile

        blank = [None] * bool(field)
        try:
            with open_bytes(path, content) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                for entry in filter(wanted, tar):
                    value = []
                    if field == "content" and entry.size > row_bytes:
                        yield [path, entry.name, entry.size, None, f"member: {entry.size} bytes do not fit a row"]
                        continue
                    if field:
                        try:
                            value = [take(tar.extractfile(entry))]
                        except (tarfile.TarError, OSError, EOFError) as e:
                            yield [path, entry.name, entry.size, *blank, f"member: {e}"]
                            continue
                    yield [path, entry.name, entry.size, *value, None]
        except (tarfile.TarError, OSError, EOFError) as e:
            yield [path, None, None, *blank, f"archive: {e}"]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                held, size = [], 0
                for row in rows_of(path, content):
                    held.append(row)
                    size += 200 + (len(row[3]) if field and row[3] is not None else 0)
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)
    return read


def tar_members(archives: DataFrame, with_content: bool = True, row_bytes: int = ROW_BYTES) -> DataFrame:
    """S5 ``extract_databases_from_tar``: regular members whose name ends in .db (any case), and error rows."""
    reader = _read_members(lambda stream: stream.read(), "content", row_bytes) if with_content else _read_members(None, None)
    return archives.select("path", "content").mapInPandas(reader, _COLUMNS.format(what="content binary, " * with_content))


def member_hashes(archives: DataFrame) -> DataFrame:
    """A9 inside archives: (archive, member, length, sha256_hash, error), digested while the member streams by."""
    return archives.select("path", "content").mapInPandas(_read_members(sha256_of, "sha256_hash"),
                                                          _COLUMNS.format(what="sha256_hash string, "))


def archive_errors(members: DataFrame) -> DataFrame:
    return members.filter(F.col("error").isNotNull()).select("archive", "member", "error")


def database_listing(archives: DataFrame) -> DataFrame:
    """S5/K5 ``list_databases_in_tar``: member names per archive, sorted."""
    found = tar_members(archives, with_content=False).filter(F.col("error").isNull())
    return found.select("archive", "member", "length").orderBy("archive", "member")


def members_as_files(members: DataFrame) -> DataFrame:
    """Archive members in the shape of a ``binaryFile`` row (for S6)."""
    return members.filter(F.col("error").isNull()).select(
        F.concat(F.col("archive"), F.lit("!/"), F.col("member")).alias("path"), F.col("length"), F.col("content"))
