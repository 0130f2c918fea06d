"""Scans: JSON lines with bad rows counted, tails, text corpora, markdown knowledge bases, SQLite tables and configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import grams

TEXT_SUFFIXES = ["txt", "md", "rst", "py", "js", "ts", "java", "c", "cpp", "h", "go", "rs", "rb", "php", "sh", "sql", "html", "css", "json", "yaml", "yml", "toml", "xml", "csv"]

TRAINING_PAIR = "ts string, prompt string, reasoning string, response string, budget_retries int, prompt_hash string"
QUALITY_SCORE = "ts string, route string, score int, reason string, scorer string, prompt_len int, response_len int, prompt_hash string, score_v2 double, step_labels array<int>, score_legacy int"
DECISION = "ts string, route string, strategy string, decision string, domain string, sample_prompt string, entropy_class string, confidence double, probe_entropy double, entropy_score double, probe_ms long, total_ms long, prompt_len long, budget_retries long"
FEW_SHOT = "input string, output string, score int, tags array<string>, ts string"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with the number of bad lines); blank lines are neither."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return lines.filter("_corrupt_record is null").drop("_corrupt_record"), lines.agg(F.count("_corrupt_record").alias("bad"))


def tail(rows: DataFrame, n: int = 200, order: str = "seq") -> DataFrame:
    """The last n rows of all (planned as top-k, not as a sort)."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def text_corpus(spark: SparkSession, path: str, suffixes: list[str] = TEXT_SUFFIXES) -> DataFrame:
    """(path, text) of whole files, recursively; bytes that are not UTF-8 are replaced."""
    glob = "*.{" + ",".join(suffixes) + "}"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def knowledge_base(spark: SparkSession, path: str, collections: dict[str, str], default: str = "code", suffixes: tuple[str, ...] = ("md",)) -> DataFrame:
    """(path, text, collection) of markdown files; the collection by the folder above the file."""
    docs = text_corpus(spark, path, list(suffixes))
    table = F.create_map(*[F.lit(x) for pair in collections.items() for x in pair]) if collections else F.create_map().cast("map<string,string>")
    return docs.withColumn("collection", F.coalesce(F.try_element_at(table, F.element_at(F.split("path", "/"), -2)), F.lit(default)))


def tail_by_group(rows: DataFrame, group: str, n: int, order: str = "seq") -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))).filter(F.col("_rn") <= n).drop("_rn")


#: Rows of a SQLite table to a task.
SQLITE_ROWS = 1_000_000
_SQLITE_KINDS = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string"}


def _plain_path(path: str) -> str:
    """A path as a host's tools take it."""
    return re.sub("^file:/*", "/", path)


def sqlite_table(spark: SparkSession, path: str, table: str, rows: int = SQLITE_ROWS) -> DataFrame:
    """A SQLite table, read by tasks in ranges of ``rows`` row numbers; path: a database, or a folder of databases (``*.db``).

    The databases must be reachable under their path from every executor (a shared mount).  Only their declared columns and largest row
    numbers are read by the driver; column types follow the declarations of the first that has the table.  Databases without it have no rows.
    """
    import sqlite3

    if not table.isidentifier():
        raise ValueError(f"not a table name: {table}")
    path = _plain_path(path)
    files = sorted(str(f) for f in Path(path).glob("*.db")) if Path(path).is_dir() else [path]
    columns, splits = [], []
    for f in files:
        with sqlite3.connect(f"file:{f}?mode=ro", uri=True) as con:
            told = [(c[1], _SQLITE_KINDS.get(c[2].upper().split("(")[0], "string")) for c in con.execute(f"PRAGMA table_info({table})")]
            if not told:
                continue
            columns = columns or told
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            splits += [(f, a, min(a + rows - 1, high)) for a in range(low, high + 1, rows)] if low is not None else []
    if not columns:
        raise ValueError(f"no table {table} under {path}")
    names, schema = [c for c, _ in columns], T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns))
    kinds = [pa.int64() if t == "long" else pa.float64() if t == "double" else pa.string() for _, t in columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with sqlite3.connect(f"file:{f}?mode=ro", uri=True) as con:
                    found = con.execute(f"SELECT {', '.join(names)} FROM {table} WHERE rowid BETWEEN ? AND ?", (a, b))
                    while part := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    parts = spark.createDataFrame(splits, "file string, a long, b long")
    return parts.repartition(max(1, len(splits)), "file", "a").mapInArrow(read, schema)


#: What no path may hold that a shell sees.
SHELL = ";|&$`<>\n\"'*?(){}"


def csv_allowed(path: str, roots: list[str]) -> bool:
    """Whether a path is a plain ``.csv`` file under one of the roots, without shell characters."""
    if any(c in path for c in SHELL) or not path.lower().endswith(".csv"):
        return False
    real = Path(path).resolve()
    return real.is_file() and any(real.is_relative_to(Path(r).resolve()) for r in roots)


def csv_files_allowed(asked: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``asked`` (path, relative to ``root``) with ``allowed``, for many paths: a plain .csv among ``files`` (path), inside the root, without shell characters.

    Steps ``.`` and ``..`` are followed in the text of the path; one that leaves the root is refused.
    """
    steps = F.filter(F.split("path", "/"), lambda s: ~s.isin("", "."))
    up = F.transform(steps, lambda s: F.when(s == "..", -1).otherwise(1))
    # the depth after each step, and the least of them: below none, the path leaves the root
    depth = F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.aggregate(F.slice(up, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    inside = (F.size(up) > 0) & F.forall(depth, lambda d: d >= 0)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    plain = ~F.exists(F.split("path", ""), lambda c: c.isin(*SHELL)) & F.lower("path").endswith(".csv") & ~F.startswith("path", F.lit("/"))
    rows = asked.withColumn("_real", F.when(plain & inside, F.concat_ws("/", F.lit(_plain_path(root)), F.array_join(walked, "/"))))
    known = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_real"), F.lit(True).alias("_there")).distinct()
    return rows.join(known, "_real", "left").withColumn("allowed", F.coalesce("_there", F.lit(False))).drop("_real", "_there")


class Config:
    """A JSON or (where the yaml package is there) YAML configuration file, read again when it changes."""

    def __init__(self, path: str):
        self.path, self.seen, self.data = Path(path), -1.0, {}

    def get(self) -> dict:
        if self.path.exists() and (now := self.path.stat().st_mtime) > self.seen:
            self.data, self.seen = self._parsed(self.path.read_text(encoding="utf-8")), now
        return self.data

    def _parsed(self, text: str) -> dict:
        if self.path.suffix not in (".yaml", ".yml"):
            return json.loads(text)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the yaml package is needed for this file; JSON needs none") from e
        return yaml.safe_load(text) or {}


def not_ingested(urls: DataFrame, known: DataFrame) -> DataFrame:
    return urls.join(known.select("url").distinct(), "url", "left_anti")


def channels(catalog: DataFrame) -> DataFrame:
    """(key, channel_id, place): every key of a catalog of channels (channel_id, handle, name, slug), in the order in which the catalog has them.

    A handle counts without its leading signs, handle and name in lower case.  ``place`` is where a key first occurs; of several channels with
    one key the last has it.  catalog may have ``seq``, its order; else channels are in the order of their ids.
    """
    order = "seq" if "seq" in catalog.columns else "channel_id"
    keys = [F.col("channel_id").cast("string"), F.lower(F.regexp_replace("handle", "^@+", "")), F.lower("name"), F.col("slug")]
    named = F.array(*[F.struct(F.struct(F.col(order).alias("seq"), F.lit(i).alias("field")).alias("place"), k.alias("key")) for i, k in enumerate(keys)])
    rows = catalog.select("channel_id", F.inline(named)).filter("key <> ''")
    return rows.groupBy("key").agg(F.max_by("channel_id", "place").alias("channel_id"), F.min("place").alias("place"))


def resolve_channels(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, channel_id) of asked names: of the key that is the name in lower case, else of the first key that is part of it.

    Parts are runs of a name that have the length, the first and the last characters of a key, so catalogs and names may be of any number.
    A name that equals an id as written is that channel.  Nulls and names that hold no key have no row.
    """
    from ..session import written

    keys = written(channels(catalog), "keys")
    names = asked.select("asked").filter("asked is not null").distinct().withColumn("name", F.lower("asked"))
    parts = grams.windows(names.select(F.struct("asked", "name").alias("n"), "name"), keys, "n", "name", "key").select("n.*", "key")
    # as written: only where that differs, and of a shape that some key has
    whole = grams.windows(names.filter("asked <> name").select(F.struct("asked", "name").alias("n"), "asked"), keys, "n", "asked", "key").select("n.*", "key").filter("key = asked")
    found = parts.unionByName(whole).join(keys, "key")
    way = F.when(F.col("key") == F.col("asked"), 0).when(F.col("key") == F.col("name"), 1).otherwise(2)
    return found.groupBy("asked").agg(F.min_by("channel_id", F.struct(way, "place")).alias("channel_id"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of PDF files, for an extractor beyond the boundary."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
