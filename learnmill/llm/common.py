"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnmill.plans.session import ensure_package

#: A word is a longest run of characters other than space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row: bound as a lambda variable, so that the
    optimizer cannot inline it into inner lambdas, where it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: str | None) -> list[bytes]:
    """Same words as words_of, in UTF-8: bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster (spark.checkpoint.dir). Where it is unset, one of our own, which a cluster's executors would not see: then only
    for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="learnmill-")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = "_" + name
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def tidy(spark: SparkSession):
    """Jobs inside drop their own shuffle files when they end, as what they write is read from its table, and hand at most 2000 rows to Python at once."""
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", records: str(min(2000, int(spark.conf.get(records, "10000"))))}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/learnmill-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._learnmill_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if getattr(df, "_learnmill_path", None):
            delete_path(df.sparkSession, df._learnmill_path)


def by_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc long, text) of the rows that have an id, and whether rows repeat an id. If so, one row of each id is taken: the one with the least
    text. Only ids are shuffled if none repeats."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    if texts.groupBy("doc").count().where("count > 1").limit(1).count():
        return texts.groupBy("doc").agg(F.min("text").alias("text")), True
    return texts, False


#: What tasks of this worker keep for later tasks of the same operator: owner -> what frees it.
_held: dict[str, Callable[[], object]] = {}


def hold(owner: str, free: Callable[[], object]) -> None:
    """Tells that an operator keeps something in this worker until a task of another one comes."""
    _held[owner] = free


def release(owner: str = "") -> None:
    """Frees what tasks of operators other than ``owner`` left in this worker, if anything."""
    others = [name for name in _held if name != owner]
    for name in others:
        _held.pop(name)()
    if others:
        give_back()


def give_back() -> None:
    """Returns memory that this worker does not use to the system: workers live on between tasks, and with them what their allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run, schema, owner: str = "") -> DataFrame:
    """df.mapInArrow, with this package importable for the workers. A task first frees what other operators hold in its worker, and gives back unused memory at its end."""
    ensure_package(df.sparkSession)

    def task(batches):
        release(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Component of every node that an edge (a, b) names: rows (node, component), the component being
    its smallest node. Alternates large-star and small-star steps until nothing changes; each
    node's smallest neighbour is found by a map-side combined minimum and joined back through an
    exchange of its own on both sides, so that adaptive execution can split a hub's rows.
    Node ids are integers; self loops are allowed, null ends are not linked."""
    spark = edges.sparkSession
    scratch_dir(spark)
    work = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").distinct().checkpoint()
    loops = work.where("a = b").select(F.col("a").alias("node"))
    nodes = loops.union(work.select("a")).union(work.select("b")).distinct().checkpoint()
    work = work.where("a <> b")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select((F.col("a").bitwiseXOR(F.lit(0))).alias("k"), F.least("a", "m").alias("m"))
        joined = pairs.join(least.hint("merge"), pairs["a"] == least["k"])
        kept = joined.where("b > a") if large else joined
        linked = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            linked = linked.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return linked.where("a <> b").distinct()

    seen = None
    for _ in range(max_rounds):
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        after_large = star(both, True)
        down = after_large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        work = star(down, False).checkpoint()
        state = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.sum(F.col("b") % (1 << 31))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    parents = work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(parents, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def runs_by_key(batches: Iterator, key: str):
    """Groups of consecutive rows with equal key, as pylists, over batches sorted by that key."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[-1][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class Forest:
    """Union-find over the integers 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
