"""The wide links of operator 4, SimHash near-dedup, for its form on word similarity: documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.

Documents with equal sets are one node, with a SimHash fingerprint of the set. Fingerprints within 3 bits are linked by operator 4's grid join. But at a
similarity of 0.8 fingerprints of 64 bits differ in about 10 bits, for which no grid of segment popcounts is selective, and a bound of 12 bits would
still lose one pair in seven (figures in the README). Beside them, candidates therefore meet in MinHash bands (16 x 4): a pair at 0.8 meets in at least one
with probability 0.9998, a pair at 0.9 nearly always. What meets there is verified exactly on whole shingle sets.

Cells with the same members are kept once, cells with over ``block`` members are dealt in pairs of blocks, and links of both kinds spread by union-find
on the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_map, connected_components, fresh_name, runs_by_key, shuffle_partitions, stored
from .simhash import near_links

SHINGLE, SEED, BANDS, ROWS, SIMILARITY, BLOCK = 5, 42, 16, 4, 0.8, 256
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX, _AT_ONCE = np.uint64(0x9E3779B97F4A7C15), 1 << 14


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the text's shingles, each once; a shorter text is one shingle; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, from the least value of each of bands x rows permutations."""
    r = np.random.default_rng(SEED)
    a, b = r.integers(0, 1 << 64, (2, bands * rows, 1), dtype=np.uint64)
    a |= np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (a * hashes[i : i + _AT_ONCE] + b).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = (key ^ (key >> np.uint64(31))) * _MIX + row
    return (key ^ (key >> np.uint64(29))) * _MIX


def set_fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if over half the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def node_rows(size: int, bands: int, rows: int):
    """From batches (doc, text) to rows (doc, h1, h2, fp, b0...); h1, h2 are the 128-bit hash of the shingle set, fp its fingerprint."""
    names = ["doc", "h1", "h2", "fp", *(f"b{i}" for i in range(bands))]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            keys = np.array([band_keys(s, bands, rows) for s in sets], np.uint64).reshape(-1, bands).view(np.int64)
            columns = [*digests.T, np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64), *keys.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)

    return run, ", ".join(f"{n} long" for n in names)


def set_rows(size: int):
    """From batches (doc, text) to rows (doc, hashes): the shingle set as bytes."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["d", "hashes"])

    return run


def set_links(sets: list[np.ndarray], own: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places of similar sets, enough to connect all of them; with own, only pairs of two blocks count."""
    counts = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, marked, links = np.arange(len(sets)), np.zeros(len(known), bool), []
    for y in range(1, len(sets)):
        open_ = label[:y] != label[y]
        if own is not None:
            open_ &= own[:y] != own[y]
        if not open_.any():
            continue
        mine = codes[starts[y] : starts[y] + counts[y]]
        marked[mine] = True
        both = np.add.reduceat(marked[codes[: starts[y]]], starts[:y], dtype=np.int64)
        marked[mine] = False
        for x in np.flatnonzero(open_ & (both >= similarity * (counts[:y] + counts[y] - both))):
            if label[x] != label[y]:
                links.append((int(x), y))
                label[label == label[y]] = label[x]
    return links


def cell_links(similarity: float):
    """From batches sorted by cell to links (a, b) between documents, enough to connect each cell's links."""

    def run(batches):
        a, b = [], []
        for group in runs_by_key(batches, "cell"):
            rows = list({r["node"]: r for r in group}.values())
            if len(rows) < 2:
                continue
            own = np.array([r["own"] for r in rows]) if rows[0]["i"] != rows[0]["j"] else None
            for x, y in set_links([np.frombuffer(r["hashes"], "<u8") for r in rows], own, similarity):
                a.append(rows[x]["node"])
                b.append(rows[y]["node"])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node): the smallest id of each group of documents that links connect: of at least ``similarity``, or within 3 bits of the fingerprint."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    run, schema = node_rows(size, bands, rows)
    keys = [f"b{i}" for i in range(bands)]
    nodes = stored(arrow_map(texts, run, schema).groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.min("fp").alias("fp"), *(F.min(k).alias(k) for k in keys)).drop("h1", "h2"), "nodes")
    cells = nodes.select("node", F.explode(F.array(*keys)).alias("cell"))
    members = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all_of_them")).where("n > 1")
    buckets = members.groupBy("n", "least", "all_of_them").agg(F.min("cell").alias("bucket")).select("bucket", "n")
    met = stored(cells.join(buckets.hint("merge"), F.col("cell") == F.col("bucket")).select("cell", "node", "n"), "met")
    wanted = met.select(F.col("node").alias("w")).distinct()
    sets = arrow_map(texts.join(wanted, F.col("doc") == F.col("w"), "left_semi"), set_rows(size), "d long, hashes binary")
    blocks = F.ceil(F.col("n") / block).cast("long")
    dealt = met.join(sets, F.col("node") == F.col("d")).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(F.xxhash64("cell", i, j).alias("cell"), i.alias("i"), j.alias("j"), "own", "node", "hashes")
    links = arrow_map(dealt.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell"), cell_links(similarity), "a long, b long")
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(first.select(F.col("fp").alias("k_fp"), "first").hint("merge"), F.col("fp") == F.col("k_fp")).where("node <> first").select("first", "node")
    links = links.union(same).union(near_links(first.select(F.col("first").alias("node"), "fp")))
    linked = connected_components(stored(links, "links")).where("node <> component").select(F.col("node").alias("k"))
    return nodes.select("node").join(linked, F.col("node") == F.col("k"), "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that have a smaller document in their group; all columns stay, whatever their names. Null and empty texts have the empty set and are one group.
    Rows with a null id stay. Ids are integers; a row that repeats an id with the same text is treated like the other; if the texts differ, all rows of the id
    stay where one of them is the first of its group. An empty table gives an empty one."""
    name = fresh_name(docs, "kept")
    kept = first_of_groups(docs, id_col, text_col, **how).select(F.col("node").alias(name)).distinct()
    return docs.join(kept, docs[id_col] == kept[name], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
