"""What the operators of this subpackage share: tables in shared storage, text helpers, files."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_unset_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder on this machine stands in for a session that runs on this machine alone;
    on a cluster it is an error.
    """
    global _unset_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _unset_root is None:
        _unset_root = "file://" + tempfile.mkdtemp(prefix="likeness-")
    return _unset_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, when nothing lazy reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` in shared storage with ``_at``, a number of its own for each row, whose upper bits say in which part it was written."""
    return materialize(df.withColumn("_at", F.monotonically_increasing_id()), name)


def picker(choice: DataFrame, name: str):
    """A function of Arrow batches of a placed table that leaves the rows that ``choice`` (_at, and what it says of them) has.

    The choice is dealt to a file for each part of the placed table, and a task reads those of the parts that it holds. So the
    placed table stays where it is. What the choice says of a row is appended to its columns. It has no ``_at`` twice.
    """
    path = shared_path(choice.sparkSession, name)
    # The lower 33 bits count the rows of a part.
    choice.withColumn("_part", F.shiftright("_at", 33)).repartition("_part").write.partitionBy("_part").parquet(path)
    more = [c for c in choice.columns if c != "_at"]

    def chosen(part: int) -> pa.Table:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = file_system(path)
        files = system.get_file_info(fs.FileSelector(f"{root}/_part={part}", allow_not_found=True))
        tables = [pq.read_table(f.path, filesystem=system, partitioning=None) for f in files if f.path.endswith(".parquet")]
        return pa.concat_tables(tables).sort_by("_at").combine_chunks() if tables else None

    def pick(batches):
        import numpy as np

        part, known = None, None
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_at")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at >> 33)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo and at[lo] >> 33 != part:
                    part = int(at[lo] >> 33)
                    known = chosen(part)
                if hi == lo or known is None:
                    continue
                held = known["_at"].to_numpy()
                where = np.minimum(np.searchsorted(held, at[lo:hi]), len(held) - 1)
                hit = held[where] == at[lo:hi]
                rows, of = batch.slice(lo, hi - lo).filter(pa.array(hit)), pa.array(where[hit])
                extra = [known[c].combine_chunks().take(of) for c in more]
                extra = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in extra]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, *more])

    return pick


def fill(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(fill(text), F.lit(WORD)).cast("long")


def ascii_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() without arguments cuts at exactly WORD's white space."""
    return text.encode("utf-8", "surrogatepass").split()


def code_words(pattern: str = r"\w+"):
    return re.compile(pattern)


def file_system(uri: str):
    """A pyarrow file system and the path in it; works on executors, for any store pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def slices(batch, columns: list[str], rows: int = 512):
    """Rows of an Arrow batch as Python lists, a bounded number at a time, so that long texts never pile up."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
