"""Tables in the folder that the cluster shares, and grouped Arrow passes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and all tasks run in the driver's own process (tests).
LOCAL_DIR = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, read from the session. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_DIR
    return found.rstrip("/")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from being one of `taken`, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def whole_texts(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows in this session, where it has more: rows hold whole texts, and a batch is held by the
    JVM and by its worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, "1000")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


#: Most keys that are broadcast as hot ones, and bits of a sieve: sizes that don't grow with the data.
HOT_KEYS, SIEVE_BITS = 10_000, 26


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left (a stored table) joined with right (a stored table with one row a key and `n`, the key's rows in left) on
    key; `n` isn't in the result. The keys that hold more than one row in HOT_KEYS are fewer than HOT_KEYS: they're
    broadcast, and the rest, of which none is hot, is shuffled."""
    total = right.agg(F.sum("n")).first()[0] or 0
    hot, rest = right.where(F.col("n") * HOT_KEYS > total).drop("n"), right.where(F.col("n") * HOT_KEYS <= total).drop("n")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return left.join(F.broadcast(hot), key, how).unionByName(cold)


def sieve(df: DataFrame, column, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df with a flag `name` that is false only where the long column isn't among keys[key]: a bitmap, broadcast as 2^20 words of
    64 bits at most at any number of keys. What passes must be joined; what doesn't needn't be shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c, F.lit("sieve")), F.lit(1 << SIEVE_BITS))
    slot, word, bits = fresh([*df.columns, name], "slot", "word", "bits")
    held = keys.select(place(F.col(key)).alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, int(slot & 63)) AS bit")
    held = held.groupBy("word").agg(F.bit_or("bit").alias(bits)).withColumnRenamed("word", word)
    marked = df.withColumn(slot, place(column))
    marked = marked.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(held), word, "left")
    flag = F.coalesce(F.expr(f"shiftright({bits}, int({slot} & 63)) & 1"), F.lit(0)) == 1
    return marked.select(*(marked[c] for c in df.columns), flag.alias(name))


def bitmap(words: DataFrame) -> np.ndarray:
    """The bits of (word, bits), put together: SIEVE_BITS of them at any number of rows."""
    table = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.int64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    return held


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Size of the files that df is read from, as the plan has it; no data is read. What isn't read from files counts 0."""
    todo, total = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        size = 0 if children else int(str(node.stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0  # Spark says 2^63 - 1 where it doesn't know
        todo += children
    return total


def steady(docs: DataFrame, name: str = "docs") -> DataFrame:
    """docs if it's read from files by projections and filters alone, so that every pass meets the same rows in the
    same partitions; else docs as a stored table."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "Union", "LogicalRelation") and not node.nodeName().startswith("Relation"):
            return stored(docs, name)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs


def lean(fn: Callable) -> Callable:
    """The Arrow pass fn, whose worker gives memory back to the system at its end. Workers are kept for later stages, and an executor
    of several cores and passes has several of them, so what each held at its peak would add up from stage to stage."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def grouped(df: DataFrame, key: str, order: list[str], fn: Callable[[int, dict[str, list]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """One Arrow pass over the rows of each key: df dealt by key and sorted, fn(key, columns) gives batches of output.

    Rows of a key meet in one task, so keys must stand for bounded groups (hash buckets, chunks). Within it, the rows
    come in the given order.
    """
    names = df.columns
    dealt = (df.repartition(parts, key) if parts else df.repartition(key)).sortWithinPartitions(key, *order)

    def run(batches):
        current, held = None, None

        def flush():
            yield from fn(current, held)

        for batch in batches:
            keys = batch.column(key)
            if len(keys) == 0:
                continue
            ids = keys.to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            columns = {c: batch.column(c).to_pylist() for c in names}
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held is not None and ids[a] == current:
                    for c in names:
                        held[c] += columns[c][a:b]
                    continue
                if held is not None:
                    yield from flush()
                current, held = int(ids[a]), {c: columns[c][a:b] for c in names}
        if held is not None:
            yield from flush()

    return dealt.mapInArrow(lean(run), schema)
