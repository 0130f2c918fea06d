"""Sinks: appends, snapshots that never overwrite what is being read, vector collections, notes, and the n-gram table file."""

from __future__ import annotations

import re
import shutil
import struct
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import fnv1a as fnv1a_column
from ..session import written
from . import collection


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_sqlite(rows: DataFrame, folder: str, table: str) -> int:
    """Appends rows to a folder of SQLite databases, one of each task; the number of rows.  A task that runs again replaces its database.

    The folder must be reachable under its path from every executor (a shared mount).
    """
    import os
    import sqlite3
    import uuid

    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "int": "INTEGER", "bigint": "INTEGER"}
    if not table.isidentifier() or not all(c.isidentifier() and t in kinds for c, t in rows.dtypes):
        raise ValueError("names must be identifiers, and columns texts or numbers")
    folder, run, columns = re.sub("^file:/*", "/", folder), uuid.uuid4().hex, ", ".join(f"{c} {kinds[t]}" for c, t in rows.dtypes)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        part = TaskContext.get().partitionId()
        name, fresh, n = f"{folder}/{run}-{part:06d}.db", f"{folder}/.{uuid.uuid4().hex}", 0
        con = sqlite3.connect(fresh)
        con.execute(f"CREATE TABLE {table} ({columns})")
        for batch in batches:
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            n += batch.num_rows
        con.commit()
        con.close()
        os.replace(fresh, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def archive(rows: DataFrame, folder: str, key: str = "run_id") -> None:
    """Adds records of patches as JSON, one line each, under ``folder`` by run; ``patch_diff`` is cut to 5000 characters."""
    cut = rows.withColumn("patch_diff", F.substring(F.coalesce("patch_diff", F.lit("")), 1, 5000)) if "patch_diff" in rows.columns else rows
    cut.withColumn("_run", F.col(key)).write.mode("append").partitionBy("_run").json(folder)


def named_notes(notes: DataFrame, index: DataFrame, most: int = 60) -> DataFrame:
    """``notes`` (title, date, url, category, source_type, and domain and channel where known) with ``path``: where each goes.

    The folder is domain/channel, else the source type; the name is date and slug, with _2, _3 ... where the index (path) or notes
    before it (by url) have that name.  A title without letters or digits is untitled; the category of a known channel is its domain.
    """
    slug = tx.slug(F.coalesce("title", F.lit("")), most)
    folder = F.when(F.col("domain").isNotNull(), F.concat_ws("/", "domain", F.coalesce("channel", "source_type"))).otherwise(F.col("source_type"))
    base = F.concat(folder, F.lit("/"), F.col("date"), F.lit("_"), F.when(slug == "", "untitled").otherwise(slug))
    rows = notes.withColumn("category", F.coalesce("domain", "category")).withColumn("_base", base)
    # what the index has: a name counts for its base, and for the name itself, as that may end like a number
    taken = index.select(F.regexp_replace("path", r"\.md$", "").alias("name"))
    taken = taken.select(F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "_[0-9]+$", "")))).alias("_base")).groupBy("_base").agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("url")) + F.coalesce("_n", F.lit(0))
    rows = rows.join(taken, "_base", "left").withColumn("_nth", nth)
    return rows.withColumn("path", F.concat("_base", F.when(F.col("_nth") > 1, F.concat(F.lit("_"), "_nth")).otherwise(""), F.lit(".md"))).drop("_base", "_n", "_nth")


def index_notes(notes: DataFrame, root: str, at: str) -> int:
    """Adds ``named_notes`` to the index of notes, a versioned collection, as ingested at the time ``at``; the new version."""
    entry = ["url", "title", "category", "date", "path", "source_type"]
    return collection.append(notes.select(*entry, F.lit(at).alias("ingested_at")), root)


def write_back(prompts: DataFrame, root: str, key: str = "domain") -> DataFrame:
    """Puts prompts (key, system_prompt) in the place of those of a collection; versions before are the backups.

    Returns for each prompt its length before (null: there was none and nothing is written) and now.
    """
    spark = prompts.sparkSession
    old = collection.read(spark, root)
    known = written(prompts.select(key, F.col("system_prompt").alias("_new")).join(old.select(key, F.coalesce(F.length("system_prompt"), F.lit(0)).alias("before")), key, "left"), "prompts")
    fresh = known.filter("before is not null").select(key, "_new")

    def change(rows: DataFrame) -> DataFrame:
        return rows.join(fresh, key, "left").withColumn("system_prompt", F.coalesce("_new", "system_prompt")).select(*rows.columns)

    collection.rewrite(spark, root, change, "write back")
    return known.select(key, "before", F.length("_new").alias("now"))


#: Between the notes of one file.
NOTE_END = "\n␞\n"


def write_notes(rows: DataFrame, path: str) -> None:
    """One markdown text for each row (title, url, category, date, body, bullets)."""
    note = F.concat(
        F.lit("# "), "title", F.lit("\n\n**URL** : "), "url", F.lit("\n**Category** : "), "category", F.lit("\n**Date** : "), "date", F.lit("\n\n"), "body",
        F.when(F.size("bullets") > 0, F.concat(F.lit("\n\n- "), F.array_join("bullets", "\n- "))).otherwise(""),
    )
    rows.select(note.alias("value")).write.mode("append").option("lineSep", NOTE_END).text(path)


#: Fixed values of the n-gram table file: magic, version and sizes of its header and slots, little endian.
#: A slot holds the context's hash (0: empty), the offset of its nexts within the data section, and their total frequency.
MAGIC, VERSION, HEADER, SLOT = 0x454E4752, 1, struct.Struct("<5I"), struct.Struct("<QII")


def fnv1a(ids: list[int]) -> int:
    h = 0xCBF29CE484222325
    for b in b"".join(struct.pack("<I", i) for i in ids):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


#: Contexts of a table file; its slots and offsets are 32 bits, and a host maps it whole.
CONTEXTS = 50_000_000


def write_ngram_file(table: DataFrame, path: str, order: int, most: int = CONTEXTS) -> int:
    """An open-addressed table file of (ctx array<int>, next int, freq int), for one host to map.

    The file is one host's lookup table and so bounded: contexts are counted, and more than ``most`` are refused.  Bodies are
    streamed in order of hash to a file of their own, so that only the slots (16 bytes each) are held.
    """
    import numpy as np

    g = table.groupBy("ctx").agg(F.sort_array(F.collect_list(F.struct(F.col("freq"), (-F.col("next")).alias("minus"))), asc=False).alias("nexts"))
    h = fnv1a_column(F.transform("ctx", lambda x: x.cast("long")))
    g = g.select("ctx", "nexts", h["hi"].alias("hi"), h["lo"].alias("lo"))
    n = table.select("ctx").distinct().count()
    if n > most:
        raise ValueError(f"{n} contexts; a table file holds {most} at most")
    size = 1 << (max(2 * n, 16) - 1).bit_length()
    slots = np.zeros(size, [("hash", "<u8"), ("offset", "<u4"), ("total", "<u4")])
    at = 0
    with open(f"{path}.data", "wb") as data:
        for row in g.orderBy("hi", "lo").toLocalIterator():
            k = (found := row["hi"] << 32 | row["lo"]) % size
            while slots["hash"][k]:
                k = (k + 1) % size
            slots[k] = (found, at, sum(x["freq"] for x in row["nexts"]))
            at += data.write(struct.pack("<I", len(row["nexts"])) + b"".join(struct.pack("<II", -x["minus"], x["freq"]) for x in row["nexts"]))
    with open(path, "wb") as f, open(f"{path}.data", "rb") as data:
        f.write(HEADER.pack(MAGIC, VERSION, order, size, n))
        f.write(slots.tobytes())
        shutil.copyfileobj(data, f)
    Path(f"{path}.data").unlink()
    return n


class NgramFile:
    """Reader of such a file; refuses a wrong magic, version or length."""

    def __init__(self, path: str):
        self.raw = Path(path).read_bytes()
        if len(self.raw) < HEADER.size:
            raise ValueError("truncated header")
        magic, version, self.order, self.size, self.entries = HEADER.unpack_from(self.raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not an n-gram table of this version")
        if len(self.raw) < HEADER.size + self.size * SLOT.size:
            raise ValueError("truncated table")

    def lookup(self, ctx: list[int]) -> list[tuple[int, int]]:
        """(next, freq), most frequent first."""
        h = fnv1a(ctx)
        k, data = h % self.size, HEADER.size + self.size * SLOT.size
        for _ in range(self.size):
            found, at, _total = SLOT.unpack_from(self.raw, HEADER.size + k * SLOT.size)
            if not found:
                return []
            if found == h:
                n = struct.unpack_from("<I", self.raw, data + at)[0]
                return [struct.unpack_from("<II", self.raw, data + at + 4 + 8 * i) for i in range(n)]
            k = (k + 1) % self.size
        return []


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``rows`` (file, seq, body) as one file of each name, bodies in the order of ``seq``: (file, n), how many rows a file is of.

    Tasks write a file each, which gets its name once it is whole; ``path`` must be reachable under its name from every executor.
    """
    import os
    import uuid

    import pyarrow as pa

    from ..session import written

    def put(part: pa.Table) -> pa.Table:
        os.makedirs(path, exist_ok=True)
        name, fresh = part["file"][0].as_py(), os.path.join(path, f".{uuid.uuid4().hex}")
        with open(fresh, "wb") as f:
            for body in part.sort_by("seq")["body"]:
                f.write((body.as_py() or "").encode())
        os.replace(fresh, os.path.join(path, name))
        return pa.table({"file": [name], "n": pa.array([len(part)], pa.int64())})

    return written(rows.select("file", "seq", "body").groupBy("file").applyInArrow(put, "file string, n long"), "files")


def verify_ngram_file(table: DataFrame, path: str, sample: int = 100) -> int:
    """Looks up at most ``sample`` contexts (by hash order) of a table file or folder and compares their nexts, rows of one next added up; the number that differ."""

    def some(share: float) -> DataFrame:
        # of the contexts of least hash alone, as the table may be large
        return table if share == 1 else table.filter(F.xxhash64("ctx") < int(-(1 << 63) + share * (1 << 64)))

    return differing(some, table.count(), path, sample)


def differing(some: Callable[[float], DataFrame], n: int, path: str, sample: int = 100) -> int:
    """Of ``some`` (a share of the contexts of a table of ``n`` rows: ctx, next, freq), at most ``sample`` are looked up in a table file or folder; the number that differ."""
    from .ngram_file import NgramTable

    f, share = NgramTable(path), 4.0
    while True:
        part = min(1.0, share * sample / max(n, 1))
        g = some(part).groupBy("ctx", "next").agg(F.sum("freq").alias("freq")).groupBy("ctx").agg(F.collect_set(F.struct("next", "freq")).alias("nexts")).orderBy(F.xxhash64("ctx")).limit(sample).collect()
        if len(g) >= sample or part == 1:
            break
        share *= 16
    return sum(set(f.lookup(r["ctx"])) != {(n["next"], n["freq"]) for n in r["nexts"]} for r in g)
