"""Stored tables of which one version at a time is seen: bucket folders are written anew, then a small manifest is switched.

A store is a folder of named tables, each cut into hash buckets of its key. A manifest names, for every table and
bucket, the folder with its rows; the manifest with the highest number counts. A merge writes new folders for the buckets that
it changes and then one manifest, under its final name only once it is whole. Before that moment readers see the version
before, after it the new one, for all tables of the store together.

A table whose batches replace all rows of their keys may be kept in generations instead: a batch writes its own rows only, as
table ``name@number.level``, and readers take the rows of each key from the last generation that has it. ``RUNS`` generations of a
level are written as one of the next, so a row is written about once a level and not once a batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
#: Manifests that are kept with the folders they name, the newest included.
KEPT = 3
#: Generations of one level that are made one.
RUNS = 4
#: Marks a row that only says that its key has no rows any more.
GONE = "_gone"
_MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole manifests of a store."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{root}/{_MANIFESTS}") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """``tables`` (name to bucket to folder, relative), ``batches`` (stream to its last batch) and ``keys`` of tables in generations; the newest, or that of a number."""
    numbers = manifests(spark, root)
    if not numbers:
        return {"number": 0, "tables": {}, "batches": {}, "keys": {}}
    number = numbers[-1] if number is None else number
    fs, at = _files(spark, f"{root}/{_MANIFESTS}/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return {"number": number, **json.loads(text)}


def read_table(spark: SparkSession, root: str, table: str = "rows", buckets: list[int] | None = None, known: dict | None = None) -> DataFrame | None:
    """The rows of a table in the store's current version, or in the ``known`` manifest; None if it has none.

    With ``buckets`` only those are read.
    """
    known = known or manifest(spark, root)
    found = [known["tables"][n] for n in generations(known, table) if known["tables"][n]]
    if not found:
        return None
    frames = []
    for folders in found:
        paths = [f"{root}/{f}" for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets]
        rows = spark.read.option("mergeSchema", "true").parquet(*(paths or [f"{root}/{f}" for f in folders.values()]))
        frames.append(rows if paths else rows.limit(0))
    rows = newest_of(frames, known.get("keys", {}).get(table, []))
    return rows.where(F.col(GONE).isNull()).drop(GONE) if GONE in rows.columns else rows


def generations(known: dict, table: str) -> list[str]:
    """The names of a table's generations in a manifest, the oldest first; of a table without any, its own name."""
    return sorted((n for n in known["tables"] if n.split("@")[0] == table), key=lambda n: int(n.partition("@")[2].split(".")[0] or -1))


def newest_of(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of each key from the last of the frames that has it."""
    if len(frames) == 1:
        return frames[0]
    rows = frames[0].withColumn("_run", F.lit(0))
    for i, frame in enumerate(frames[1:], 1):
        rows = rows.unionByName(frame.withColumn("_run", F.lit(i)), allowMissingColumns=True)
    last = rows.groupBy(*keys).agg(F.max("_run").alias("_run"))
    return rows.join(last, [*keys, "_run"], "left_semi").drop("_run")


def write_generation(rows: DataFrame, root: str, table: str, known: dict, keys: list[str], buckets: int, given: DataFrame | None = None) -> dict[str, dict]:
    """Writes rows that replace all of their keys as a new generation of the table; gives the changes to commit.

    Keys that are ``given`` and have no rows have none afterwards. Generations of which there are enough go into the new one.
    """
    spark, fresh = rows.sparkSession, rows
    if given is not None:
        none = given.select(*keys).join(rows.select(*keys).distinct(), keys, "left_anti").withColumn(GONE, F.lit(True))
        fresh = rows.withColumn(GONE, F.lit(None).cast("boolean")).unionByName(none, allowMissingColumns=True)
    held, level, merged = generations(known, table), 0, []
    while len(same := [n for n in held if n.endswith(f".{level}")]) >= RUNS - 1:
        merged, held, level = same + merged, [n for n in held if n not in same], level + 1
    older = [spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{f}" for f in known["tables"][n].values()]) for n in merged if known["tables"][n]]
    whole = newest_of([*older, fresh], keys).withColumn(BUCKET, bucket_of(keys, buckets))
    made = write_buckets(whole, root, table, list(range(buckets)))
    return {**{n: dict.fromkeys(known["tables"][n]) for n in merged}, f"{table}@{known['number'] + 1}.{level}": made}


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, root: str, table: str, touched: list[int]) -> dict[str, str | None]:
    """Writes rows that have ``_bucket`` to a new folder; gives the folder of each touched bucket, None for one without rows.

    A bucket is written by as many tasks as its size asks for.
    """
    spark, folder = rows.sparkSession, f"{table}/{uuid.uuid4().hex}"
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    made = {n.split("=")[1] for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{BUCKET}=")}
    return {str(b): f"{folder}/{BUCKET}={b}" if str(b) in made else None for b in touched}


def commit(spark: SparkSession, root: str, before: dict, changes: dict[str, dict[str, str | None]], batch: tuple[str, int] | None = None,
           keys: dict[str, list[str]] | None = None) -> int:
    """Makes the changed buckets of all tables current, as the version after ``before``; gives its number.

    Fails if another writer has made that version meanwhile. Folders that none of the last manifests names are removed.
    """
    tables = {name: dict(folders) for name, folders in before["tables"].items()}
    for name, folders in changes.items():
        own = tables.setdefault(name, {})
        for bucket, folder in folders.items():
            own.pop(bucket, None)
            if folder is not None:
                own[bucket] = folder
    tables = {name: folders for name, folders in tables.items() if folders or "@" not in name}
    keys = {**before.get("keys", {}), **(keys or {})}
    batches = {**before["batches"], **({batch[0]: batch[1]} if batch else {})}
    number = before["number"] + 1
    fs, target = _files(spark, f"{root}/{_MANIFESTS}/{number:012d}.json")
    _, waiting = _files(spark, f"{root}/{_MANIFESTS}/.{uuid.uuid4().hex}")
    stream = fs.create(waiting)
    stream.write(bytearray(json.dumps({"tables": tables, "batches": batches, "keys": keys}).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(waiting, target):
        fs.delete(waiting, False)
        raise RuntimeError(f"version {number} of {root} exists already: another writer was faster")
    expire(spark, root)
    return number


def expire(spark: SparkSession, root: str, keep: int = KEPT) -> None:
    """Removes manifests before the last ``keep``, and the folders of whole versions that only those name."""
    numbers = manifests(spark, root)
    fs, _ = _files(spark, root)
    old, live = numbers[:-keep], numbers[-keep:]
    if not old:
        return

    def named(number: int) -> set[str]:
        return {f.rsplit("/", 1)[0] for folders in manifest(spark, root, number)["tables"].values() for f in folders.values()}

    used = set().union(*map(named, live))
    for number in old:
        for folder in named(number) - used:
            fs.delete(_files(spark, f"{root}/{folder}")[1], True)
        fs.delete(_files(spark, f"{root}/{_MANIFESTS}/{number:012d}.json")[1], False)
