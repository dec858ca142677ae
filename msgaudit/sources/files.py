"""Evidence files and their SHA-256 fingerprints.

Files are listed and read by Spark's ``binaryFile`` source (one row per file:
path, modificationTime, length, content), so listing, reading and hashing are
spread over the cluster.  The platform of a file is taken from its path.
Members of archives are fingerprinted while their archive is read
(``archive.member_hashes``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import ROW_BYTES, open_bytes, sha256_of

# Fixed values (must equal the reference): the app packages whose data is
# examined, and the platform each stands for.
PLATFORM_PACKAGES = {
    "com.facebook.katana": "Facebook",
    "com.instagram.android": "Instagram",
    "com.facebook.orca": "Messenger",
}

DB_GLOB = "*.[dD][bB]"


def scan_files(spark: SparkSession, root: str, glob: str = DB_GLOB) -> DataFrame:
    """Every file under ``root`` (recursively) whose name matches ``glob``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root))


def basename(path_col) -> F.Column:
    return F.regexp_extract(path_col, r"([^/\\]+)\z", 1)


def platform_of(path_col) -> F.Column:
    """Platform from a known package name in the path, else the parent folder."""
    expr = None
    for pkg, name in PLATFORM_PACKAGES.items():
        hit = path_col.contains(pkg)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    parent = F.regexp_extract(path_col, r"([^/\\]+)[/\\][^/\\]+\z", 1)
    return expr.otherwise(parent)


def hash_inventory(files: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(database_file, sha256_hash) plus full path, platform and size.

    Every file is in the inventory: those that fit a row are hashed in the JVM,
    larger ones are streamed through the digest on an executor.
    """
    def shape(df: DataFrame, digest) -> DataFrame:
        return df.select(basename(F.col("path")).alias("database_file"), digest.alias("sha256_hash"),
                         "path", platform_of(F.col("path")).alias("platform"), "length")

    small = files.filter(F.col("length") <= row_bytes)
    large = stream_hashes(files.filter(F.col("length") > row_bytes))
    return shape(small, F.sha2(F.col("content"), 256)).unionByName(shape(large, F.col("sha256_hash")))


def stream_hashes(files: DataFrame) -> DataFrame:
    """A10 for files of any size: (path, length, sha256_hash), read from their store on the executors."""
    def digests(batches):
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                with open_bytes(path, None) as stream:
                    found.append(sha256_of(stream))
            yield pdf.assign(sha256_hash=found)

    return files.select("path", "length").mapInPandas(digests, "path string, length long, sha256_hash string")
