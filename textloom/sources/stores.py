"""Vector collections and keyed tables as immutable parts under a manifest: what is written under a key replaces what was there.

A write adds one part of its own rows (or tombstones of deleted keys) and reads nothing of the others; parts are merged by
size. Reading takes, for each key, the row of the newest part that holds it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import delete, exists, safe_path
from .manifest import Manifest

DISTANCES = ("cosine", "dot", "euclid")

#: At least so many parts are merged at a time; parts of fewer than SMALL rows count as such.
TOGETHER, SMALL = 4, 1000

GONE = "_gone"


def _due(parts: list[dict]) -> int:
    """How many of the newest parts are to be merged: the most of which none is larger than the others together, so that
    each merge at least doubles the part that a row is in."""
    sizes = [max(p["rows"], SMALL) for p in reversed(parts)]
    return max((n for n in range(TOGETHER, len(sizes) + 1) if 2 * max(sizes[:n]) <= sum(sizes[:n])), default=0)


def _live(parts: list[dict]) -> list[dict]:
    """Parts that readers see, oldest first; those merged into others wait for the next merge to be deleted."""
    return sorted((p for p in parts if not p.get("merged")), key=lambda p: p["seq"])


def _open(spark: SparkSession, path: str, part: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(part["schema"])).parquet(f"{path}/{part['folder']}")


def _merged(spark: SparkSession, path: str, parts: list[dict], key: str) -> DataFrame:
    """The newest row, or tombstone, of each key in parts (oldest first). Only the newer parts are grouped by key; the oldest,
    which is the largest as a rule, only loses the keys that they hold."""
    first, *newer = [_open(spark, path, p) for p in parts]
    if not newer:
        return first
    rows = None
    for n, part in enumerate(newer):
        part = part.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    if len(newer) > 1:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in first.columns if c != key]), "_n").alias("_row")).select(key, "_row.*")
    rows = rows.select(*first.columns)
    return first.join(rows.select(key), key, "left_anti").select(*first.columns).unionByName(rows)


def _put(rows: DataFrame, path: str, key: str, schema: StructType) -> dict:
    """Write a part: hashed and sorted by key, in files by their bytes, with Bloom filters for looking keys up."""
    spark, folder = rows.sparkSession, f"part-{uuid.uuid4().hex}"
    try:
        dealt = rows.hint("rebalance", F.col(key)).sortWithinPartitions(key)
        dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/{folder}")
        found = spark.read.schema(schema).parquet(f"{path}/{folder}").groupBy(key).agg(F.count("*").alias("n"))
        n, most, nulls = found.agg(F.sum("n"), F.max("n"), F.count(F.when(F.col(key).isNull(), 1))).first()
        if nulls:
            raise ValueError(f"rows without {key}")
        if n and most > 1:
            raise ValueError(f"several rows have one {key}")
    except BaseException:
        delete(spark, f"{path}/{folder}")
        raise
    return {"folder": folder, "rows": n or 0, "key": key, "schema": json.loads(schema.json())}


def _add(rows: DataFrame, path: str, key: str, schema: StructType) -> int:
    """Write rows as the newest part and merge what is due; the number of the manifest that lists it."""
    spark, manifest = rows.sparkSession, Manifest(rows.sparkSession, path)
    part = _put(rows, path, key, schema)
    if not part["rows"]:
        delete(spark, f"{path}/{part['folder']}")
        live = _live(manifest.read()[1])
        if live:
            return manifest.read()[0]
        part = _put(rows, path, key, schema)  # An empty table has one empty part.
    number, parts = manifest.change(lambda parts: [*parts, {**part, "seq": 1 + max((p["seq"] for p in parts), default=0)}])
    compact(spark, path)
    return number


def compact(spark: SparkSession, path: str) -> int:
    """Merge newest parts as long as some are due; returns how many merges there were. A merge that another writer came
    before is left to that one."""
    manifest, merges = Manifest(spark, path), 0
    while True:
        live = _live(manifest.read()[1])
        n = _due(live)
        if not n:
            return merges
        due, key = live[-n:], live[-1]["key"]
        rows = _merged(spark, path, due, key)
        whole = n == len(live)
        made = _put(rows.filter(f"NOT {GONE}") if whole else rows, path, key, StructType.fromJson(due[0]["schema"]))
        made["seq"], names = due[-1]["seq"], {p["folder"] for p in due}
        gone: list[str] = []

        def swap(parts):
            gone.clear()
            now = _live(parts)
            at = [i for i, p in enumerate(now) if p["folder"] in names]
            if len(at) != n or (whole and at[0] != 0):
                return None
            gone.extend(p["folder"] for p in parts if p.get("merged"))
            kept = [p for p in parts if not p.get("merged")]
            return [{**p, "merged": True} if p["folder"] in names else p for p in kept] + [made]

        _, parts = manifest.change(swap)
        if made["folder"] not in {p["folder"] for p in parts}:
            delete(spark, f"{path}/{made['folder']}")
            return merges
        for folder in gone:
            delete(spark, f"{path}/{folder}")
        merges += 1


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table as its newest manifest has them, or None where none was written. A reader keeps what it opened
    through one merge; the next one deletes what the first replaced."""
    live = _live(Manifest(spark, path).read()[1])
    return _merged(spark, path, live, live[0]["key"]).filter(f"NOT {GONE}").drop(GONE) if live else None


def find(spark: SparkSession, path: str, keys: list) -> DataFrame | None:
    """The rows of some keys, by the Bloom filters and statistics of each part's files."""
    live = _live(Manifest(spark, path).read()[1])
    if not live:
        return None
    key, rows = live[0]["key"], None
    for p in live:
        part = _open(spark, path, p).filter(F.col(key).isin(keys)).withColumn("_n", F.lit(p["seq"]).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c not in (key, "_n")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_n").alias("_row")).select(key, "_row.*")
    return newest.filter(f"NOT {GONE}").drop(GONE)


def upsert_table(rows: DataFrame, path: str, key: str) -> int:
    """Put rows in the place of those of the same key; returns the number of the manifest that holds them.

    Only the rows given are written, with merges later on: some logarithm of writes for each row in all. Readers see whole
    writes only, doing one again leaves no second copy, and of two writers at a time neither loses its rows; a key that both
    write has the row of the one that came last. Several rows of one key, or none as key: an error, and nothing is changed.
    Columns are those of the first write, whatever their order; others are left out, missing ones are an error.
    """
    live = _live(Manifest(rows.sparkSession, path).read()[1])
    if live and live[0]["key"] != key:
        raise ValueError(f"the table's key is {live[0]['key']}")
    if live:
        schema = StructType.fromJson(live[0]["schema"])
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema if f.name != GONE])
    rows = rows.withColumn(GONE, F.lit(False))
    return _add(rows, path, key, schema if live else _nullable(rows.schema))


def delete_keys(keys: DataFrame, path: str) -> int:
    """Delete the rows of some keys, given in a column of the table's key; keys that aren't there change nothing. Writes one
    tombstone for each key."""
    spark = keys.sparkSession
    number, parts = Manifest(spark, path).read()
    live = _live(parts)
    if not live:
        return number
    schema = StructType.fromJson(live[0]["schema"])
    key = live[0]["key"]
    some = keys.select(F.col(key).cast(schema[key].dataType).alias(key)).filter(F.col(key).isNotNull()).distinct()
    value = lambda f: F.col(key) if f.name == key else F.lit(True if f.name == GONE else None).cast(f.dataType).alias(f.name)
    return _add(some.select(*[value(f) for f in schema]), path, key, schema)


def _nullable(schema: StructType) -> StructType:
    """Tombstones have nulls everywhere."""
    return StructType([type(f)(f.name, f.dataType, True) for f in schema])


def ensure_collection(spark: SparkSession, root: str, name: str, dimensions: int = 1536, distance: str = "cosine") -> bool:
    """Create a collection of vectors; False where it is there already, which changes nothing."""
    if distance not in DISTANCES or dimensions < 1:
        raise ValueError("distance must be cosine, dot or euclid, and dimensions at least 1")
    path = safe_path(root, name)
    if exists(spark, f"{path}/meta/_SUCCESS"):
        return False
    spark.createDataFrame([(name, dimensions, distance)], "name string, dimensions int, distance string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return True


def put_vectors(rows: DataFrame, root: str, name: str) -> int:
    """Write (chunk_id, vector, ...) into a collection, new rows in place of old ones of their chunk_id. A vector of another
    length than the collection's is an error."""
    spark, path = rows.sparkSession, safe_path(root, name)
    dimensions = spark.read.parquet(f"{path}/meta").first().dimensions
    bad = F.when(F.size("vector") != dimensions, F.raise_error(F.lit(f"vectors must have {dimensions} dimensions")))
    return upsert_table(rows.withColumn("vector", F.coalesce(bad.cast(rows.schema["vector"].dataType), F.col("vector"))), f"{path}/points", "chunk_id")


def vectors(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return read_latest(spark, f"{safe_path(root, name)}/points")


def delete_vectors(keys: DataFrame, root: str, name: str) -> int:
    """Delete vectors by a column chunk_id."""
    return delete_keys(keys, f"{safe_path(root, name)}/points")


def collection_info(spark: SparkSession, root: str, name: str) -> DataFrame:
    """name, dimensions, distance, vectors; an error where there is no such collection."""
    meta = spark.read.parquet(f"{safe_path(root, name)}/meta")
    points = vectors(spark, root, name)
    n = spark.range(1).select(F.lit(0).cast("long").alias("vectors")) if points is None else points.agg(F.count("*").alias("vectors"))
    return meta.join(n, F.lit(True))


def delete_collection(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there was one."""
    return delete(spark, safe_path(root, name))
