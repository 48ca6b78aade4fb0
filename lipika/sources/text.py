"""Readers of text corpora as lines or documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.errors import ConfigError, require
from lipika.functions.text import is_blank, is_clean_line, trimmed
from lipika.operators.corpus import configured, lines_of, offset_limit, require_text

#: Sentences for a first try, used where no corpus is named.
SAMPLE = tuple(
    "".join(map(chr, codes))
    for codes in (
        (0x0986, 0x09AE, 0x09BF, 0x20, 0x09AC, 0x09BE, 0x0982, 0x09B2, 0x09BE, 0x20, 0x09AD, 0x09BE, 0x09B2, 0x09CB, 0x09AC, 0x09BE, 0x09B8, 0x09BF, 0x0964),
        (0x09A8, 0x09A6, 0x09C0, 0x20, 0x09AC, 0x09AF, 0x09BC, 0x09C7, 0x20, 0x09AF, 0x09BE, 0x09AF, 0x09BC, 0x0964),
        (0x09B8, 0x09CD, 0x09A4, 0x09CD, 0x09B0, 0x09C0, 0x20, 0x0993, 0x20, 0x09B6, 0x09BF, 0x0995, 0x09CD, 0x09B7, 0x09BE, 0x0964),
        (0x0986, 0x0995, 0x09BE, 0x09B6, 0x20, 0x09A8, 0x09C0, 0x09B2, 0x0964),
    )
)


#: The order of the lines that the readers give: by file, by the split's place in it, and by the row in the split.
ORDER = ("file", "block", "row")


def _lines(raw: DataFrame) -> DataFrame:
    """``file``, ``block``, ``row``, ``line``: valid UTF-8 (bad bytes are replaced), without blank lines; the first three give the order."""
    text = F.make_valid_utf8(F.regexp_replace("value", r"\r$", ""))
    place = F.col("_metadata.file_block_start")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), place.alias("block"), F.monotonically_increasing_id().alias("row"), text.alias("line"))
    return rows.filter(~is_blank(F.col("line")))


def listing(spark: SparkSession, patterns: list[str], max_files: int | None = None) -> list[str]:
    """Files of the patterns (of any file system that Spark reaches), each once, in the order of their names, at most ``max_files``."""
    require(max_files is None or max_files >= 1, f"max_files must be >= 1, got {max_files}")
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found |= {str(s.getPath()) for s in path.getFileSystem(conf).globStatus(path) or () if s.isFile()}
    return sorted(found)[:max_files]


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file, which must exist."""
    require(bool(listing(spark, [path])), f"corpus file not found: {path}", ConfigError)
    return _lines(spark.read.text(path))


def load_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of many files or patterns; those that cannot be read are passed over, but something must be left."""
    found = listing(spark, paths)
    require(bool(found), f"nothing to read in {len(paths)} paths", ConfigError)
    raw = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text(found)
    return require_text(_lines(raw))


def load_dir(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Lines of all matching files below a folder."""
    require("://" in folder or os.path.isdir(folder), f"not a directory: {folder}", ConfigError)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return require_text(_lines(raw))


def line_slice(spark: SparkSession, paths: list[str], offset: int = 0, limit: int | None = None, max_files: int | None = None) -> DataFrame:
    """Lines that are not blank from ``offset`` on, at most ``limit``, trimmed, over the files in the order of their names."""
    found = listing(spark, paths, max_files)
    require(bool(found), f"nothing to read in {len(paths)} paths", ConfigError)
    rows = offset_limit(_lines(spark.read.text(found)), offset, limit, list(ORDER))
    return rows.withColumn("line", trimmed(F.col("line")))


def landed(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """The paths of shards that a landing job has put in place under their final names; a missing one, or one still under a temporary name, is an error."""
    there = {p.rsplit("/", 1)[-1]: p for p in listing(spark, [f"{folder}/*"])}
    missing = [n for n in names if n not in there]
    require(not missing, f"shards that have not landed in {folder}: {missing}", ConfigError)
    return [there[n] for n in names]


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``doc_id``, ``text``."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sample(spark: SparkSession) -> DataFrame:
    return inline(spark, list(SAMPLE))


def documents(
    spark: SparkSession, path: str | list[str], doc_type: str | None = None, limit: int | None = None, offset: int = 0, clean: bool = False,
    order: list[str] | None = None, max_files: int | None = None, max_files_scan: int | None = None,
) -> DataFrame:
    """Lines of Parquet documents (``text`` and perhaps ``type``): filter on type, slice, split, and filter lines.

    ``path`` may be patterns; of their files, in the order of names, ``max_files`` are read, or
    ``max_files_scan`` where that is given. Blank documents don't count for ``offset`` and ``limit``.
    The type is filtered in the scan; only the wanted documents' texts are split.
    """
    most = max_files if max_files_scan is None else max_files_scan
    paths = [path] if isinstance(path, str) else path
    docs = spark.read.parquet(*(paths if most is None else listing(spark, paths, most)))
    if doc_type is not None:
        docs = docs.filter(F.col("type") == doc_type)
    docs = docs.filter(~is_blank(F.col("text")))
    if limit is not None or offset:
        docs = offset_limit(docs, offset, limit, order or ["doc_id"])
    lines = lines_of(docs, "text", sentences=True)
    return lines.filter(is_clean_line(F.col("line"))) if clean else lines


def splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "validation", "test"), offset: int = 0, limit: int | None = None, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The splits of a data set one after another, with ``split_no``; a slice of them runs over the splits."""
    out = None
    for k, name in enumerate(names):
        part = spark.read.parquet(f"{folder}/{name}.parquet").withColumn("split_no", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return offset_limit(out, offset, limit, ["split_no", *order]) if limit is not None or offset else out


def config(path: str) -> dict:
    """A training configuration in JSON: an object with ``corpus_sources``, and perhaps ``total_lines``, ``algo``, ``vocab_size``, ``min_atom_freq``, ``zwnj_policy``, ``paths`` (name -> patterns of text files)."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"no usable configuration in {path}: {e}") from e
    require(isinstance(found, dict) and isinstance(found.get("corpus_sources"), dict), f"{path} has no corpus_sources")
    return found


def corpus(spark: SparkSession, settings: dict) -> DataFrame:
    """The weighted corpus of a configuration, from the text files that its ``paths`` name: ``doc_id`` (the place in the mix) and ``text``."""
    paths = settings.get("paths") or {}
    unavailable = tuple(k for k in settings["corpus_sources"] if paths.get(k) == [])
    sources = {k: load_paths(spark, v) for k, v in paths.items() if k in settings["corpus_sources"] and v}
    mixed = configured(settings, sources, unavailable, list(ORDER))
    return mixed.select(F.xxhash64("source", "place").alias("doc_id"), F.col("line").alias("text"))
