"""Files that driver and executors share.

Spark jobs cut their lineage with tables written below the folder named by ``spark.checkpoint.dir``; operators
that own a file format (archives, token shards) write below it too, through the file system that the folder's URI
names, so that any executor can read what another one wrote.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

from ..sources.shared import KEY, materialise, shared_path, shared_root

#: Bytes of a batch of rows that go to a Python worker at once; a longer text goes alone.
BATCH = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["BATCH", "KEY", "bound_batches", "materialise", "open_fs", "shared_path", "shared_root", "write_atomically"]


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in batches of bounded bytes (10,000 long texts are no batch)."""
    now = df.sparkSession.conf.get(_BATCHES, None)
    if now and now.rstrip("b").isdigit() and int(now.rstrip("b")) > BATCH:
        df.sparkSession.conf.set(_BATCHES, f"{BATCH}b")
    return df


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (``file:``, ``hdfs:``, ``s3:`` ...) or of a plain local path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_atomically(path: str, write) -> None:
    """Call ``write(stream)`` on a temporary name and move the file into place.

    A task that is tried again replaces the file by one with the same content, so readers never see half a file.
    """
    system, name = open_fs(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        write(out)
    system.move(part, name)
