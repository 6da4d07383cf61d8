"""Helpers that the operators of this package share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space and the five ASCII controls
#: that follow tab; ``bytes.split`` cuts UTF-8 text in just these places.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names, in the default file system if it
    names no other; a folder of our own is set only where a session on a
    single machine names none; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Of each open ``temporaries`` the paths that it deletes, the innermost last.
_SCOPES: list[list[str]] = []


def staged(df: DataFrame, kind: str) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again.

    Lineage ends there, so that a lost executor costs no more than the tasks
    that were running on it.  Inside ``temporaries`` the table lives as long as
    that does.
    """
    return _written(df, kind, _SCOPES[-1] if _SCOPES else None)


def _written(df: DataFrame, kind: str, scope: list[str] | None) -> DataFrame:
    path = fresh_dir(df.sparkSession, kind)
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession):
    """Deletes at its end the tables that were staged within.

    Gives a function that stages a table which outlives it.
    """
    scope: list[str] = []
    outer = _SCOPES[-1] if _SCOPES else None
    _SCOPES.append(scope)
    try:
        yield lambda df, kind="kept": _written(df, kind, outer)
    finally:
        _SCOPES.pop()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in scope:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


#: Keys of at least one of so many rows are joined by broadcast; there are no more of them than that.
HOT_KEYS = 10_000


def dealt(rows: DataFrame, by_key: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row a key and in ``n`` the number of the key's rows.

    Keys with more than a ``HOT_KEYS``-th of all rows are at most that many: they
    are broadcast, so that no task gets all rows of one.  The others are
    shuffled.  ``n`` is left out.
    """
    total = by_key.agg(F.sum(n)).first()[0] or 0
    least = total // HOT_KEYS + 1
    hot = by_key.filter(F.col(n) >= least)
    cold = by_key.filter(F.col(n) < least)
    joined = rows.join(F.broadcast(hot), key)
    if not cold.isEmpty():
        joined = joined.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
    return joined.drop(n)


class SharedFiles:
    """Files in the shared folder, from the driver or any executor."""

    def __init__(self, folder: str):
        url = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
        self.fs, self.root = pafs.FileSystem.from_uri(url)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def commit(self, name: str, write: Callable) -> None:
        """Calls ``write(stream)`` on a temporary file, then renames it.

        A second attempt of the same task writes the same bytes and takes the
        place of the first, so readers see one whole file or none.
        """
        temporary = self.path(f".{name}.{uuid.uuid4().hex}")
        with self.fs.open_output_stream(temporary, compression=None) as stream:
            write(stream)
        final = self.path(name)
        if self.fs.type_name not in ("local", "s3", "gcs") and self.fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.fs.delete_file(final)
        self.fs.move(temporary, final)

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus``; nulls count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's texts; nulls become empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Marks that may stand at the ends of words.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_words(text: str) -> list[bytes]:
    """Words in lower case without marks at their ends."""
    return list(filter(None, map(bytes.strip, text.lower().encode("utf-8", "surrogatepass").split(), repeat(_MARKS))))


def bucket(data: bytes, bits: int) -> int:
    """A stable hash of some bytes to ``bits`` bits."""
    return (zlib.crc32(data) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows: those whose keys have the smallest hashes.

    A count gives a threshold that leaves hardly more than ``limit`` rows, so
    what is sorted doesn't grow with the table.
    """
    n = rows.count()
    hashed = rows.withColumn("_h", F.xxhash64(F.col(key)))
    if n > limit:
        most = -(2**63) + int(2**64 * min(1.0, (limit + 6 * limit**0.5 + 10) / n)) - 1
        hashed = hashed.filter(F.col("_h") <= F.lit(min(most, 2**63 - 1)).cast("long"))
    return hashed.orderBy("_h", key).limit(limit).drop("_h")


BLOCK = 4096


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum over all tasks of the vector that ``count`` makes of each one's rows.

    Each task sends one vector of ``length`` numbers, cut into blocks which
    are added up by block: what is moved does not depend on the rows of any
    key, and what the driver gets is one vector of fixed length.
    """

    def partial(batches):
        total = count(batches)
        for start in range(0, length, BLOCK):
            part = total[start : start + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([start], pa.int32()), "part": pa.array([part.astype("<f8").tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(raw, "<f8") for raw in rows.column("part").to_pylist()], axis=0)
        return pa.table({"block": rows.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part binary"
    parts = df.mapInArrow(partial, schema).groupBy("block").applyInArrow(add, schema).collect()
    total = np.zeros(length)
    for row in parts:
        part = np.frombuffer(row["part"], "<f8")
        total[row["block"] : row["block"] + len(part)] = part
    return total
