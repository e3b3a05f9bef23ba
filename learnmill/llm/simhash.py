"""Operator 4, SimHash near-dedup over segment popcounts.

A fingerprint's 64 bits are cut into segments of two bits, and its embedding is the number of bits set in each
segment. The Manhattan distance of two embeddings is a lower bound of the Hamming distance of the fingerprints, so
fingerprints within ``3`` bits are within 3 in the grid of embeddings, and in one half of the segments within 1.
The grid join therefore meets on half embeddings: each fingerprint stands in the cell of either half, and also
visits the cells one step up. What meets in a cell is verified exactly.

Only different fingerprints are joined; copies hang on their fingerprint's smallest doc_id. A cell gives a
spanning forest of its links, not all pairs. Cells with over ``block`` rows are dealt in pairs of blocks, so no task
holds more than two blocks of one cell, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_map, connected_components, fresh_name, shuffle_partitions

SHINGLE, SEED, BITS, BLOCK = 3, 42, 3, 4096
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_EVEN = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit b is set if over half the hashes of the shingles (repeats included) have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long. Whole texts; null and empty texts have 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def grid_cells(batches):
    """From batches (node, fp) to rows (cell, home, node, fp): home cells, and cells a step up for visitors.
    A cell is a half embedding (32 bits) with the number of its half above."""
    for batch in batches:
        node, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        grid = u - ((u >> np.uint64(1)) & _EVEN)  # a popcount of 0 to 2 in every two bits
        for half in (0, 1):
            at = ((grid >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64) | (half << 32)
            cells, homes, rows = [at], [np.ones(len(at), bool)], [np.arange(len(at))]
            for segment in range(16):
                up = np.flatnonzero(((at >> (2 * segment)) & 3) < 2)
                cells.append(at[up] + (1 << (2 * segment)))
                homes.append(np.zeros(len(up), bool))
                rows.append(up)
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)), pa.array(node[rows]), pa.array(fp[rows])], names=["cell", "home", "node", "fp"])


def forest_of(node: np.ndarray, fp: np.ndarray, home: np.ndarray, block: np.ndarray | None, bits: int) -> tuple[list, list]:
    """Edges of a spanning forest of the links in a cell; with block, only links between two blocks count."""
    label = np.arange(len(node))
    a, b = [], []
    for i in np.flatnonzero(home):
        near = np.bitwise_count(fp ^ fp[i]) <= bits
        if block is not None:
            near &= block != block[i]
        hit = np.flatnonzero(near)
        others = np.unique(label[hit])
        others = others[others != label[i]]
        for other in others:
            a.append(node[i])
            b.append(node[hit[np.argmax(label[hit] == other)]])
        if len(others):
            label[np.isin(label, others)] = label[i]
    return a, b


def cell_links(bits: int):
    def run(batches):
        held: pa.RecordBatch | None = None

        def edges(batch):
            """All groups of a batch of whole groups."""
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)])
            home, node, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
            u = fp.view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(node)]])
            homes = np.concatenate([[0], np.cumsum(home)])
            worth = np.flatnonzero((np.diff(starts) > 1) & (np.diff(homes[starts]) > 0))
            a, b = [], []
            for g in worth:
                s, e = starts[g], starts[g + 1]
                if e - s == 2:
                    if int(u[s] ^ u[s + 1]).bit_count() <= bits and (key[1, s] == key[2, s] or own[s] != own[s + 1]):
                        a.append(node[s])
                        b.append(node[s + 1])
                    continue
                x, y = forest_of(node[s:e], u[s:e], home[s:e], None if key[1, s] == key[2, s] else own[s:e], bits)
                a += x
                b += y
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def whole(batch):
            """The batch up to its last group, and the rest."""
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            same = np.ones(batch.num_rows, bool)
            for i in range(3):
                same &= batch.column(i).to_numpy(zero_copy_only=False) == last[i]
            cut = int(np.argmax(same))
            return batch.slice(0, cut), batch.slice(cut)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None and held.num_rows:
                batch = pa.concat_batches([held, batch])
            done, held = whole(batch)
            if done.num_rows:
                yield edges(done)
        if held is not None and held.num_rows:
            yield edges(held)

    return run


def near_links(nodes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the nodes (node, fp), enough to connect all that are linked within ``bits`` (at most
    3) differing bits. Fingerprints must be distinct."""
    if bits > 3:
        raise ValueError("halves within one step hold for at most 3 bits")
    spark = nodes.sparkSession
    cells = arrow_map(nodes.select("node", "fp"), grid_cells, "cell long, home boolean, node long, fp long")
    hot = cells.groupBy("cell").count().where(F.col("count") > block).select(F.col("cell").alias("hot_cell"), F.ceil(F.col("count") / block).alias("n"))
    dealt = cells.join(hot, F.col("cell") == F.col("hot_cell"), "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "home", "node", "fp", "own")
    met = dealt.repartition(shuffle_partitions(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return arrow_map(met, cell_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per input row: id_col, fp (signed long), component_id: the smallest id reachable over links of at most
    ``bits`` differing bits, itself included.

    Null, empty and wordless texts all have fingerprint 0 and are linked like any other. Rows with a null id get
    the component of their fingerprint, null if no row has an id there. Repeated rows stay. Ids are integers;
    other columns are ignored."""
    fps = fingerprints(docs, id_col, text_col, size).checkpoint() if _prepare(docs) else None
    groups = fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("node"))
    nodes = groups.where("node is not null").checkpoint()
    components = connected_components(near_links(nodes, bits))
    of_fp = nodes.join(components, "node").select(F.col("fp").alias("k"), "component")
    least = groups.select((F.col("fp").bitwiseXOR(F.lit(0))).alias("k0"), "node")
    named = least.join(of_fp, F.col("k0") == F.col("k"), "left").select((F.col("k0").bitwiseXOR(F.lit(0))).alias("key"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, fps["fp"] == named["key"], "left").select(id_col, "fp", "component_id")


def _prepare(docs: DataFrame) -> bool:
    from .common import scratch_dir

    return bool(scratch_dir(docs.sparkSession))


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bits: int = BITS) -> DataFrame:
    """docs without those that have a smaller document in their group; all columns stay. Rows with a null id stay."""
    name = fresh_name(docs, "kept")
    found = near_duplicates(docs, id_col, text_col, size, bits)
    kept = found.where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, docs[id_col] == kept[name], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that have a smaller document in their group of near copies, by fingerprints and by word similarity; see neardup.keep_one."""
    from . import neardup

    return neardup.keep_one(docs, id_col, text_col, **how)
