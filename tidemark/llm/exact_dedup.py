"""Exact dedup: a streaming query whose keyed state (RocksDB on disk, no expiry) holds for each digest
the stable identifier of the row that stays, where its content lies, and how many rows came; rows whose
digest was there already are read again by their place and have their full bytes compared.

DataFrame operations only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few_of_many, fresh_name, normalised, scratch, setting, without, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches in which a table is read, about.
BATCHES = 3
#: Megabytes of an executor, outside the heap, that RocksDB's caches and write buffers share, over all partitions; state beyond is on disk.
STATE_MB = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def plain_scan(df: DataFrame) -> bool:
    """Whether df is files read with columns and rows chosen, so that each row of a file comes once at most.

    Paths that were named twice, or a folder beside what lies in it, give rows twice.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if not node.nodeName().startswith("LogicalRelation"):
        return False
    paths = node.relation().location().rootPaths()
    roots = sorted(paths.apply(i).toString().rstrip("/") + "/" for i in range(paths.size()))
    return not any(b.startswith(a) for a, b in zip(roots, roots[1:]))


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column at = (file, row in the file), another for each row, which is the same at every evaluation.

    Rows that don't come straight from files, once each, are written to the shared folder first.
    """
    at = fresh_name(docs, "at")

    def place(df: DataFrame) -> DataFrame:
        m = df.metadataColumn("_metadata")
        return df.select("*", F.struct(m["file_path"].alias("file"), m["row_index"].alias("row")).alias(at))

    try:
        return place(docs if plain_scan(docs) else written(docs, "located")), at
    except AnalysisException:
        return place(written(docs, "located")), at


def first_seen(landing: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The final state of the stream over the files in path: digest, keep, n.

    Each micro-batch adds its rows to the state and writes the keys that it changed; a batch that is
    run again after a failure overwrites what it wrote. Without files_per_batch there are about BATCHES.
    """
    spark, out = landing.sparkSession, scratch(landing.sparkSession, "dedup-state")
    reader = spark.readStream.schema(landing.schema).option("maxFilesPerTrigger", files_per_batch or max(1, -(-len(landing.inputFiles()) // BATCHES)))
    state = reader.parquet(path).groupBy("digest").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("n"))

    def keep_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    store = "spark__sql__streaming__stateStore__"
    with setting(spark, **{f"{store}providerClass": ROCKSDB, f"{store}rocksdb__allowFAllocate": "false", f"{store}rocksdb__boundedMemoryUsage": "true", f"{store}rocksdb__maxMemoryUsageMB": str(STATE_MB)}):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", scratch(spark, "dedup-progress"))
            .trigger(availableNow=True)
            .foreachBatch(keep_batch)
            .start()
        )
        query.awaitTermination()
    try:
        changed = spark.read.parquet(out)
    except AnalysisException:  # no file came, so no batch ran
        return spark.createDataFrame([], state.schema)
    return changed.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of docs: <id_col>, at, keep_id, group_size, kept, digest.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts
    as the empty text, and empty texts are equal to one another. Of equal texts the row with the
    smallest id stays; a null id comes after all others; rows repeated with one id are ordered by file
    and row, so exactly one row of a group stays. at names the row (file, row in it) for joining the
    decision back; other columns of docs, whatever their names, are not touched. An empty table gives
    an empty result. Two texts with one digest are told apart by their bytes.
    """
    return _decided(*located(docs), id_col, text_col, digest, files_per_batch)


def _decided(rows: DataFrame, at: str, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int | None) -> DataFrame:
    spark = rows.sparkSession
    text, place = normalised(F.col(f"`{text_col}`")), F.col(f"`{at}`")
    narrow = rows.select(F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), place.alias("at")).alias("row"), digest(text).alias("digest"))
    path = scratch(spark, "dedup-landing")
    narrow.write.parquet(path)
    landing = spark.read.schema(narrow.schema).parquet(path)
    state = first_seen(landing, path, files_per_batch)

    # Hits: rows whose digest came more than once are fetched by their places; their texts are compared byte by byte as grouping keys.
    repeated = written(state.where("n > 1").select("digest", "n"), "dedup-repeated")
    hits = written(landing.join(repeated.hint("merge"), "digest").select(F.xxhash64("row.at").alias("spot"), "row", "digest", "n"), "dedup-hits")
    with few_of_many(spark):
        again = rows.select(F.xxhash64(place).alias("spot"), place.alias("at"), text.alias("full")).join(hits.where("n > 1").hint("merge"), "spot").where(F.col("at") == F.col("row.at"))
        variants = again.groupBy("full").agg(F.first("digest").alias("digest"), F.min("row").alias("keep"), F.count(F.lit(1)).alias("n")).select("digest", "keep", "n", F.sha2("full", 512).alias("variant"))
        variants = written(variants, "dedup-groups")
    discard(repeated)
    clashing = variants.groupBy("digest").count().where("count > 1").select("digest")
    plain = landing.join(variants.join(clashing, "digest", "left_anti").drop("variant"), "digest", "left")
    result = plain.select(*_decision(id_col))
    if clashing.limit(1).count():
        clashing = written(clashing, "dedup-clashes")
        spots = hits.join(clashing, "digest", "left_semi")
        apart = (
            rows.select(F.xxhash64(place).alias("spot"), place.alias("at"), F.sha2(text, 512).alias("variant"))
            .join(spots, "spot").where(F.col("at") == F.col("row.at"))
            .select("digest", "variant", "row")
            .join(variants, ["digest", "variant"], "left")
        )
        result = plain.join(clashing, "digest", "left_anti").select(*_decision(id_col)).unionByName(apart.select(*_decision(id_col)))
    return result


def _decision(id_col: str) -> list[Column]:
    keep = F.coalesce("keep", "row")
    return [
        F.col("row.id").alias(id_col),
        F.col("row.at").alias("at"),
        keep["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (keep == F.col("row")).alias("kept"),
        F.col("digest"),
    ]


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with docs' columns, whatever their names.

    Null and empty texts are equal to one another, so one row of them stays; of rows repeated with one id
    one stays; very long texts are compared whole; an empty table gives an empty result.
    """
    rows, at = located(docs)
    dropped = _decided(rows, at, id_col, text_col, sha256, files_per_batch).where(~F.col("kept")).select(F.col("at").alias(at))
    return without(rows, at, dropped).select(*[F.col(f"`{c}`") for c in docs.columns])
