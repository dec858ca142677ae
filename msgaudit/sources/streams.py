"""Evidence bytes inside tasks: file objects from any store, and whole files into it.

Spark's ``binaryFile`` rows carry a file's bytes and reach every store that
Spark reads.  A file too large for a row (Spark's own limit of 2 GiB) is
streamed from its store instead; only its path travels.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest file that Spark puts into one row.
ROW_BYTES = (1 << 31) - (1 << 20)


#: Bytes of one Arrow batch of rows that carry files: a task's Python holds few of them at once.
ARROW_BYTES = 8 << 20


def bound_content(spark) -> None:
    """Arrow batches of bounded bytes, since rows hold whole files."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def with_content(listing: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``binaryFile`` rows as (path, length, content), content null where it has to be streamed."""
    small = listing.filter(F.col("length") <= row_bytes).select("path", "length", "content")
    large = listing.filter(F.col("length") > row_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def open_bytes(path: str, content):
    """A file object over the row's bytes, or over the store where the row has none."""
    if content is not None:
        return io.BytesIO(content)
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_stream(inner)


def sha256_of(stream) -> str:
    """SHA-256 of a stream, read block by block."""
    import hashlib

    digest = hashlib.sha256()
    while block := stream.read(1 << 20):
        digest.update(block)
    return digest.hexdigest()


def put_bytes(uri: str, data: bytes) -> None:
    """Write a file under its final name only when it is whole, so a task may run twice."""
    put_stream(uri, lambda out: out.write(data))


def put_stream(uri: str, write) -> None:
    """As :func:`put_bytes`, of what ``write`` writes into the file object, piece by piece."""
    import uuid

    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)
