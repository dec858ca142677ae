"""Evidence files derived from the driver tables, written by Spark jobs.

The reference reads message databases pulled off a phone.  To run the file
operators (S4-S8, A9) on data that grows with the given tables, every
platform's documents are written into SQLite databases, sharded so that no
database (and no task) holds more than ``rows_per_db`` messages however
skewed the platforms are, and then bundled into tar archives per platform.
Files go under the shared checkpoint directory.

Each database holds ``messages(text, sender_name, timestamp_ms)`` and
``counters(id, n)`` (a table without text columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.streams import open_bytes, put_bytes, put_stream
from .tables import read

ROWS_PER_DB = 2000      # messages per database file
DBS_PER_TAR = 16        # database files per archive
STREAM_BYTES = 4 << 20  # archives beyond this are streamed from the folder they were written to
NO_PLATFORM = "unknown"  # platform of the documents whose source is null
EPOCH_MS_BASE = 1_700_000_000_000
MS_PER_DOC = 60_000


def shard_counts(docs: DataFrame, rows_per_db: int = ROWS_PER_DB) -> DataFrame:
    """(source, shards): databases per platform."""
    return docs.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_db)).cast("long").alias("shards"))


def _db_writer(root: str):
    def write(pdf):
        import sqlite3

        import pandas as pd

        platform, shard = str(pdf["source"].iloc[0]), int(pdf["shard"].iloc[0])
        path = f"{root}/{platform}/{platform}_{shard}.db"
        conn = sqlite3.connect(":memory:")
        conn.execute("CREATE TABLE messages (text TEXT, sender_name TEXT, timestamp_ms INTEGER)")
        conn.execute("CREATE TABLE counters (id INTEGER, n INTEGER)")
        pdf = pdf.sort_values("doc_id")
        conn.executemany("INSERT INTO messages VALUES (?, ?, ?)",
                         zip(pdf["text"], pdf["lang"], pdf["timestamp_ms"].astype("int64").tolist()))
        conn.executemany("INSERT INTO counters VALUES (?, ?)",
                         zip(pdf["doc_id"].astype("int64").tolist(), pdf["n_chars"].astype("int64").tolist()))
        conn.commit()
        put_bytes(path, conn.serialize())
        conn.close()
        return pd.DataFrame({"path": [path], "platform": [platform], "rows": [len(pdf)]})

    return write


def build_databases(spark: SparkSession, sf_dir: str, rows_per_db: int = ROWS_PER_DB,
                    root: str | None = None) -> tuple[str, DataFrame]:
    """Write the sharded databases; returns (root, written files) after the job ran."""
    root = root or scratch_path(spark, "evidence")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumn("source", F.coalesce("source", F.lit(NO_PLATFORM)))  # a join by source would drop null
    docs = docs.join(shard_counts(docs, rows_per_db), "source")
    docs = docs.withColumns({
        "shard": F.pmod(F.col("doc_id"), F.col("shards")),
        "timestamp_ms": F.lit(EPOCH_MS_BASE) + F.col("doc_id") * F.lit(MS_PER_DOC),
    })
    written = (docs.groupBy("source", "shard")
                   .applyInPandas(_db_writer(root), "path string, platform string, rows long"))
    done = scratch_path(spark, "evidence-done")
    written.write.parquet(done)
    return root, spark.read.parquet(done)


def _tar_of(entries):
    """Writes a tar archive of (name, bytes) entries into a file object, entry by entry."""
    def write(out):
        import io
        import tarfile

        with tarfile.open(fileobj=out, mode="w|") as tar:
            for name, data in entries:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return write


def _tar_writer(root: str):
    def write(pdf):
        import pandas as pd

        platform, part = str(pdf["platform"].iloc[0]), int(pdf["tar_part"].iloc[0])
        path = f"{root}/{platform}_data_{part}.tar"

        def entries():
            for p in sorted(pdf["path"]):
                with open_bytes(p, None) as stream:
                    yield f"data/data/{platform}/databases/{p.rsplit('/', 1)[-1]}", stream.read()
        put_stream(path, _tar_of(entries()))
        return pd.DataFrame({"path": [path], "files": [len(pdf)]})

    return write


def build_archives(spark: SparkSession, written: DataFrame, dbs_per_tar: int = DBS_PER_TAR,
                   root: str | None = None) -> str:
    """Bundle database files into tar archives (bounded files per archive)."""
    root = root or scratch_path(spark, "archives")
    parts = written.select("path", "platform", F.floor(
        F.regexp_extract("path", r"_([0-9]+)\.db\z", 1).cast("long") / F.lit(dbs_per_tar)).alias("tar_part"))
    parts.groupBy("platform", "tar_part").applyInPandas(_tar_writer(root), "path string, files long").write.parquet(
        scratch_path(spark, "archives-done"))
    return root


def build_text_archives(spark: SparkSession, sf_dir: str, per_tar: int = ROWS_PER_DB) -> str:
    """Archives whose members ``doc_<id>.db`` hold the bytes of the documents' texts: known content for fingerprints."""
    root = scratch_path(spark, "text-archives")

    def write(pdf):
        import pandas as pd

        path = f"{root}/texts_{int(pdf['part'].iloc[0])}.tar"
        put_stream(path, _tar_of((f"d/doc_{i}.db", (t or "").encode()) for i, t in zip(pdf["doc_id"], pdf["text"])))
        return pd.DataFrame({"path": [path]})

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("part", F.floor(F.col("doc_id") / per_tar))
    docs.groupBy("part").applyInPandas(write, "path string").write.parquet(scratch_path(spark, "text-archives-done"))
    return root
