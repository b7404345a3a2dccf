"""Writers of splits, pairs, models, vectors and run records."""

from __future__ import annotations

import csv
import io
import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.sources.tables import file_sha256, fingerprint

# Columns of the ledger, in order.
LEDGER = (
    "timestamp", "name", "rung", "split", "n_queries", "pool_size", "recall@10", "recall@50", "mrr", "f1", "threshold",
    "precision@recall0.9", "p50_ms", "p95_ms", "usd_per_1k_queries", "fit_s", "git_sha",
)


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def read_text(path: str) -> str | None:
    """A small file in any storage that Spark knows; None if there is none."""
    spark, fs, file = _hadoop(path)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replace a small file in any storage that Spark knows."""
    _, fs, file = _hadoop(path)
    stream = fs.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def save_split(split: DataFrame, counts: DataFrame, path: str, source: str, seed: int, fractions: tuple[float, ...], force: bool = False) -> str:
    """The split as a CSV table ``posting_id, split``, and its manifest in a JSON file beside it.

    The manifest is written last, so a table without one is unfinished and written anew. A finished table of the same
    source, seed and fractions is left alone; one of others is an error unless ``force`` replaces it.
    """
    manifest = f"{path.removesuffix('.csv')}.json"
    wanted = {"source_csv": source, "source_sha256": file_sha256(source), "seed": seed, "fractions": list(fractions)}
    written = json.loads(read_text(manifest) or "{}")
    differs = sorted(k for k in wanted.keys() - {"source_csv"} if written.get(k) != wanted[k])
    if written and not differs:
        return path
    if written and not force:
        raise FileExistsError(f"{path} exists with another {', '.join(differs)}")
    split.select("posting_id", "split").write.mode("overwrite").csv(path, header=True)
    numbers = counts.select(F.map_from_entries(F.array(F.struct("split", F.struct("listings", "groups")))).alias("c")).toJSON().collect()
    write_text(manifest, json.dumps({**wanted, "counts": {k: v for n in numbers for k, v in json.loads(n)["c"].items()}}, indent=2))
    return path


def write_pairs(pairs: DataFrame, folder: str, name: str) -> None:
    """Pairs in full, and without scores and labels for scoring elsewhere, from one computation."""
    kept = pairs.persist()
    kept.write.mode("overwrite").csv(f"{folder}/pairs_{name}", header=True)
    kept.drop("base_score", "same").write.mode("overwrite").csv(f"{folder}/upload/pairs_{name}", header=True)
    kept.unpersist()


def write_model(model: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(model, indent=2))


def write_vectors(vectors: DataFrame, path: str, meta: dict) -> None:
    vectors.write.mode("overwrite").parquet(path)
    Path(path).with_suffix(".json").write_text(json.dumps(meta, indent=2))


def cached_table(build, source: DataFrame, path: str, **kind) -> DataFrame:
    """The table at ``path`` if it was built from the same rows with the same settings; else built and written.

    ``build`` is called without arguments. The fingerprint of ``source`` and the settings are kept beside.
    """
    spark: SparkSession = source.sparkSession
    mark = json.dumps({"fingerprint": fingerprint(source), **kind}, sort_keys=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.json")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and "\n".join(r["value"] for r in spark.read.text(f"{path}.json").collect()) == mark:
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")
    return spark.read.parquet(path)


def git_sha() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return ""


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def rounded(name: str, value: object) -> object:
    return round(value, 6 if name.startswith("usd") else 4) if isinstance(value, float) else value


def _line(values) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(values)
    return out.getvalue()


def append_ledger(path: str, record: dict) -> None:
    """Add the run's row to the ledger, which starts with its header; a file that starts otherwise is refused."""
    header, ledger = _line(LEDGER), read_text(path)
    if ledger is not None and ledger.replace("\r\n", "\n").partition("\n")[0] != header.rstrip("\n"):
        raise ValueError(f"the header of {path} is not a ledger's")
    known = record | record["metrics"]
    write_text(path, (ledger or header) + _line(rounded(c, known.get(c, "")) for c in LEDGER))


def write_run(results: str, record: dict) -> None:
    """The run's record as JSON, and its ledger row."""
    write_text(f"{results}/runs/{record['name']}__{record['split']}.json", json.dumps(record, indent=2))
    append_ledger(f"{results}/ledger.csv", record)


def ledger_table(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as a table; ``nan`` reads as NaN."""
    text = ("timestamp", "name", "rung", "split", "git_sha")
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`").cast("string" if c in text else "double").alias(c) for c in LEDGER])
