"""The listing table and the vector index as one store: a base, and the rows that each later load changed.

A load writes new folders and then commits both tables by one small file, which must not exist
yet: readers see both or neither, a failed load leaves nothing that is read, and of two
writers one fails. No stored file is ever rewritten; ``compact`` makes a new base.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dwellspark.schema import INDEX, LISTING
from dwellspark.sources.snapshots import ID_BLOCKS, hadoop_folder, id_block, lay_out_index, lay_out_listings, with_blocks

SCHEMAS = {"listings": LISTING, "index": INDEX}


class ConcurrentLoad(RuntimeError):
    """Another writer has committed this number."""


@dataclass(frozen=True)
class Commit:
    """One load: its folders, and the counts and marks that the next one goes on from."""

    number: int
    folder: str
    base: bool
    blocks: int
    last_id: int = 0
    total: int = 0
    epoch: int | None = None
    stats: dict | None = None
    rejects: str | None = None


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """The newest base and the loads after it, in order; empty if there is no store."""
    files, folder, hadoop = hadoop_folder(spark, f"{root}/loads")
    if not files.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
    found: list[Commit] = []
    for name in reversed(names):
        stream = files.open(hadoop.Path(folder, name))
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found.insert(0, Commit(**json.loads(text)))
        if found[0].base:
            break
    return found


def commit(spark: SparkSession, root: str, made: Commit) -> None:
    files, folder, hadoop = hadoop_folder(spark, f"{root}/loads")
    try:
        stream = files.create(hadoop.Path(folder, f"{made.number:08d}.json"), False)
    except Exception as error:
        if "already exists" in str(error):
            raise ConcurrentLoad(f"load {made.number} of {root}") from error
        raise
    try:
        stream.write(bytearray(json.dumps(asdict(made)).encode()))
    finally:
        stream.close()


def new_load(root: str, number: int) -> str:
    """Where a load writes; another attempt at the same number has another folder."""
    return f"{root}/data/{number:08d}-{uuid.uuid4().hex}"


def ensure_tables(spark: SparkSession, root: str, blocks: int = ID_BLOCKS) -> None:
    """Creates the empty tables if there are none; harmless if there are."""
    if commits(spark, root):
        return
    folder = new_load(root, 0)
    for name, schema in SCHEMAS.items():
        empty = spark.createDataFrame([], schema)
        (empty.withColumn("id_block", F.lit(0)) if name == "listings" else empty).write.parquet(f"{folder}/{name}")
    try:
        commit(spark, root, Commit(0, folder, True, blocks))
    except ConcurrentLoad:
        pass  # another one has created them


def read_table(spark: SparkSession, root: str, name: str, at: list[Commit] | None = None) -> DataFrame:
    """A table as of the newest commit, or of those given: base rows that no later load has, and the newest of the others."""
    known = at or commits(spark, root)
    if not known:
        raise FileNotFoundError(root)
    schema, blocks = SCHEMAS[name], known[0].blocks

    if name == "listings":
        schema = T.StructType([*schema.fields, T.StructField("id_block", T.IntegerType())])

    def part(load: Commit) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{load.folder}/{name}")

    base, later = part(known[0]), known[1:]
    if later:
        changed = reduce(DataFrame.unionByName, [part(load).withColumn("_load", F.lit(load.number)) for load in later])
        newest = changed.drop("_load")
        if len(later) > 1:
            # Ids and load numbers only; the rows that count are then read with the columns that are asked for.
            newest = changed.join(changed.groupBy("id").agg(F.max("_load").alias("_load")), ["id", "_load"]).select(*base.columns)
        base = base.join(changed.select("id"), "id", "left_anti").unionByName(newest)
    return with_blocks(base, blocks) if name == "listings" else base


def compact(spark: SparkSession, root: str, blocks: int | None = None) -> Commit:
    """A new base of all rows, laid out for searches; what costs the whole table, apart from loads."""
    known = commits(spark, root)
    last = known[-1]
    made = replace(last, number=last.number + 1, folder=new_load(root, last.number + 1), base=True, blocks=blocks or last.blocks)
    listings, index = (read_table(spark, root, name, known) for name in SCHEMAS)
    lay_out_listings(listings.drop("id_block"), f"{made.folder}/listings", made.blocks)
    lay_out_index(index, f"{made.folder}/index")
    commit(spark, root, made)
    return made


def write_load(rows: DataFrame, folder: str, name: str, blocks: int) -> DataFrame:
    """The rows that a load changed, in as many files as they have partitions; read back."""
    if name == "listings":
        rows = rows.withColumn("id_block", id_block(F.col("id"), blocks))
    rows.write.parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
