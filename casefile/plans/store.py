"""Versioned tables in a shared folder: one manifest names what every table consists of.

``root/manifests/N.json`` holds the files of all tables as of version N, and is written under another name and renamed, so that readers see
the old version or the new one, of all tables at once. A table has base files and deltas, which are merged on read;
the base of a bucketed table is one folder per bucket of its key, and a replacement writes only the buckets that it
changes. Manifests and files are kept for a time after a newer version has replaced them, for readers that hold them. One writer at a time: a second
one that commits the same version fails."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas of one size that are folded into one of the next size, and buckets of a bucketed table.
FOLD, BUCKETS = 16, 64


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, place = _path(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, root: str, version: int) -> dict:
    fs, place = _path(spark, f"{root}/manifests/{version:012d}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest; an empty one of version 0 before the first."""
    found = _versions(spark, root)
    return _read(spark, root, found[-1]) if found else {"version": 0, "tables": {}, "batches": {}}


def commit(spark: SparkSession, root: str, tables: dict[str, dict], batches: dict[str, int] | None = None) -> int:
    """Makes the given tables what the next version has in place of theirs, all at once; returns the version."""
    old = manifest(spark, root)
    new = {"version": old["version"] + 1, "time": time.time(), "tables": old["tables"] | tables, "batches": old["batches"] | (batches or {})}
    fs, place = _path(spark, f"{root}/manifests/{new['version']:012d}.json")
    _, draft = _path(spark, f"{root}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"version {new['version']} of {root} has another writer")
    return new["version"]


def _empty(spark: SparkSession, entry: dict) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromJson(entry["schema"]))


def read_entry(spark: SparkSession, entry: dict) -> tuple[DataFrame, DataFrame | None]:
    """A table's base and its deltas, if it has any."""
    paths, deltas = list(entry["base"].values()), [d["path"] for d in entry["deltas"]]
    base = spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*paths) if paths else _empty(spark, entry)
    return base, spark.read.parquet(*deltas) if deltas else None


def parts(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The published table's base, and its deltas, if it has any."""
    tables = manifest(spark, root)["tables"]
    if name not in tables:
        raise FileNotFoundError(f"{name} is not published in {root}")
    return read_entry(spark, tables[name])


def write_base(df: DataFrame, root: str, name: str) -> dict:
    """Writes a whole table; the entry for a commit."""
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return {"schema": json.loads(df.schema.json()), "base": {"all": path}, "deltas": []}


def write_delta(df: DataFrame, root: str, name: str, entry: dict, last: Column | None = None, key: str = "id") -> dict:
    """Writes a delta; the entry with it. Every ``FOLD`` deltas of one size become one, which keeps each key's row of the highest ``last``:
    a row is written again once per size, and what is written follows the deltas, not the table."""
    spark, path = df.sparkSession, f"{root}/{name}-delta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    deltas = [*entry["deltas"], {"path": path, "size": 0}]
    size = 0
    while last is not None and sum(d["size"] == size for d in deltas) >= FOLD:
        some = spark.read.parquet(*[d["path"] for d in deltas if d["size"] == size])
        folded = some.groupBy(key).agg(F.max_by(F.struct(*some.columns), last).alias("row")).select("row.*")
        path = f"{root}/{name}-delta-{uuid.uuid4().hex}"
        folded.write.parquet(path)
        deltas = [d for d in deltas if d["size"] != size] + [{"path": path, "size": size + 1}]
        size += 1
    return entry | {"deltas": deltas}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_buckets(df: DataFrame, root: str, name: str, key: str) -> dict[str, str]:
    """Writes rows by bucket of ``key``; the folder of each bucket that has rows."""
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    return {n.split("=")[1]: f"{path}/{n}" for n in _names(df.sparkSession, path) if n.startswith("_bucket=")}


def bucketed(df: DataFrame, root: str, name: str, key: str) -> dict:
    """Writes a whole table in buckets; the entry for a commit."""
    return {"schema": json.loads(df.schema.json()), "base": write_buckets(df, root, name, key), "deltas": [], "key": key}


def replace_in_buckets(spark: SparkSession, root: str, name: str, entry: dict, new: DataFrame, ids: DataFrame) -> dict:
    """The entry of a bucketed table in which the rows of the keys ``ids`` are replaced by ``new``. Only buckets of ``ids`` and
    ``new`` are read and written; the others stay the files that they are."""
    key = entry["key"]
    touched = {str(r[0]) for r in ids.select(_bucket(key)).union(new.select(_bucket(key))).distinct().collect()}  # BUCKETS at most
    if not touched:
        return entry
    old, _ = read_entry(spark, entry | {"base": {b: p for b, p in entry["base"].items() if b in touched}})
    rows = old.join(ids.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns)).select(old.columns)
    return entry | {"base": {b: p for b, p in entry["base"].items() if b not in touched} | write_buckets(rows, root, name, key)}


def publish(df: DataFrame, root: str, name: str) -> int:
    """Writes a whole table and makes it the published one."""
    return commit(df.sparkSession, root, {name: write_base(df, root, name)})


def vacuum(spark: SparkSession, root: str, keep_seconds: float = 86_400.0) -> int:
    """Removes manifests that a newer version replaced more than ``keep_seconds`` ago, and table files that only they name.
    Returns how many files and folders went."""
    limit, gone = time.time() - keep_seconds, []
    versions = _versions(spark, root)
    kept = _read(spark, root, versions[0]) if versions else None
    for version in versions[1:]:
        newer = _read(spark, root, version)
        if newer["time"] >= limit:
            break
        gone, kept = [*gone, kept], newer
    # A file that a version has dropped never comes back: what the oldest kept version does not name, none does.
    files = lambda m: {p for t in m["tables"].values() for p in [*t["base"].values(), *(d["path"] for d in t["deltas"])]}
    removed = [*(f"{root}/manifests/{m['version']:012d}.json" for m in gone), *(set().union(*map(files, gone)) - files(kept) if gone else ())]
    for path in removed:
        fs, place = _path(spark, path)
        fs.delete(place, True)
    return len(removed)
