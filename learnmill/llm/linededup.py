"""Operator 7, line dedup: fuzzy lines by MinHash.

Lines are compared lower-cased with single spaces, as sets of runs of ``k`` characters. Equal lines collapse first: what
is left is a table of distinct lines, each with a number of its own and the place where it is first. These get
``bands`` x ``rows`` MinHash values; lines that share a band's values meet in a bucket, where the exact Jaccard similarity
decides. A bucket gives a spanning forest of its links; distributed union-find joins them, and of each component the first
line (smallest document, then place) stays.

A pair of similarity s meets with probability 1 - (1 - s**rows)**bands: 0.985 at 0.8 by default, 0.9997 at 0.9, 0.06 at 0.3. Buckets
with the same members are looked at once. Buckets of more than ``block`` lines are dealt in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, arrow_map, by_id, connected_components, discard, fresh_name, runs_by_key, shuffle_partitions, stored

K, BANDS, ROWS, SIMILARITY, BLOCK = 10, 8, 4, 0.8, 128
#: Characters of lines that are hashed at once, and texts that are.
AT_ONCE, TEXTS = 64_000, 250
#: Groups of up to this many lines are compared many groups at once: at most 2**ROW_BITS lines, and about this many characters.
SMALL, ROW_BITS, CHARS = 16, 9, 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str | None) -> list[str]:
    """The lines that have a word, normalised, in order."""
    return [y for x in text.split("\n") if (y := normal_line(x))] if text else []


def first_lines(text: str | None) -> dict[str, int]:
    """The distinct normalised lines of a text, with the place of each one's first among the lines with a word."""
    found: dict[str, int] = {}
    for place, line in enumerate(normal_lines(text)):
        found.setdefault(line, place)
    return found


def shingles(line: str, k: int = K) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_codes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of k characters of the lines, one line after another, and where each line's begin. A shorter line is one run."""
    codes = np.frombuffer("".join(x.ljust(k, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([max(k, len(x)) for x in lines])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # the polynomial over k characters, put together from those over 1, 2, 4... characters
    h, done, power, size = None, 0, codes, 1
    while True:
        if k & size:
            tail = power[done:]
            h = power if h is None else h[: len(tail)] * np.uint64(pow(int(_M1), size, 1 << 64)) + tail
            done += size
        if done == k:
            break
        power = power[: len(power) - size] * np.uint64(pow(int(_M1), size, 1 << 64)) + power[size:]
        size *= 2
    h = h[: len(codes) - k + 1]
    h = (h ^ (h >> np.uint64(29))) * _M2
    valid = np.ones(len(codes), bool)
    for s in range(1, k):
        valid[starts[1:] - s] = False
    return h[valid[: len(h)]], np.concatenate([[0], np.cumsum(lengths - k + 1)[:-1]])


def band_keys(lines: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each line and band."""
    a, b = permutations(bands * rows)
    out = np.zeros((len(lines), bands), np.uint64)
    i = 0
    while i < len(lines):
        j, size = i, 0
        while j < len(lines) and (j == i or size < AT_ONCE):
            size += max(k, len(lines[j]))
            j += 1
        h, at = shingle_codes(lines[i:j], k)
        h = (h >> np.uint64(32)).astype(np.uint32)
        turned, key = np.empty_like(h), np.zeros(j - i, np.uint64)
        for p in range(bands * rows):
            np.multiply(h, a[p], out=turned)
            np.add(turned, b[p], out=turned)
            key = key * _M1 + np.minimum.reduceat(turned, at).astype(np.uint64) + np.uint64(1 + p // rows)
            if p % rows == rows - 1:
                key ^= key >> np.uint64(30)
                key *= _M2
                out[i:j, p // rows] = key ^ (key >> np.uint64(31))
                key = np.zeros(j - i, np.uint64)
        i = j
    return out


def line_rows(k: int, bands: int, rows: int):
    """From batches (doc, text) to rows (doc, place, h1, h2, b0...): each document's distinct lines, a line's 128-bit hash and its bands' keys."""
    names = ["doc", "place", "h1", "h2", *(f"b{i}" for i in range(bands))]

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, TEXTS):
                some = batch.slice(part, TEXTS)
                known: dict[str, int] = {}
                docs, places, which = [], [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found = first_lines(text)
                    docs += [doc] * len(found)
                    places += found.values()
                    which += [known.setdefault(x, len(known)) for x in found]
                if not which:
                    continue
                lines, at = list(known), np.array(which)
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.int64).reshape(-1, 2)
                keys = band_keys(lines, k, bands, rows).view(np.int64)
                columns = [np.array(docs, np.int64), np.array(places, np.int64), hashes[at, 0], hashes[at, 1], *(keys[at, i] for i in range(bands))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return run, ", ".join(f"{n} long" for n in names)


def line_texts(batches):
    """From batches (text, lines (place, node)) to rows (node, text): these lines, normalised."""
    for batch in batches:
        for part in range(0, batch.num_rows, TEXTS):
            some = batch.slice(part, TEXTS)
            nodes, texts = [], []
            for text, wanted in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                lines = normal_lines(text)
                for w in wanted:
                    nodes.append(w["node"])
                    texts.append(lines[w["place"]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["w", "text"])


def similar_in_small_groups(lines: list[str], groups: list[int], own: list[int | None], k: int, similarity: float) -> list[tuple[int, int]]:
    """Places of similar lines of one group, enough to connect those of each group; own, where not None, is a block, and only pairs of two
    blocks count. groups is in order and has few lines each; at most 2**ROW_BITS lines. All pairs are counted at once: a run's
    hash is made the group's own, sorted with the line's place in its lowest bits, and equal neighbours are counted by pair."""
    codes, starts = shingle_codes(lines, k)
    of, sizes = np.array(groups), np.diff(np.append(starts, len(codes)))
    low = np.uint64((1 << ROW_BITS) - 1)
    line_of = np.repeat(np.arange(len(lines)), sizes)
    keys = np.sort(((codes ^ (of[line_of].astype(np.uint64) + np.uint64(1)) * _M2) * _M1) & ~low | line_of.astype(np.uint64))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    code, line = keys >> np.uint64(ROW_BITS), (keys & low).astype(np.int64)
    sizes = np.bincount(line, minlength=len(lines))
    wide = int(np.bincount(of).max())
    both = np.zeros(len(lines) * wide, np.int64)
    for away in range(1, wide):
        same = np.flatnonzero(code[away:] == code[:-away])
        if not len(same):
            break
        x, y = line[same], line[same + away]
        both += np.bincount(x * wide + np.minimum(y - x, wide - 1), minlength=len(both))
    pairs = np.flatnonzero(both)
    x = pairs // wide
    y = x + pairs % wide
    similar = both[pairs] >= similarity * (sizes[x] + sizes[y] - both[pairs]) - 1e-9
    forest, links = Forest(len(lines)), []
    for a, b in zip(x[similar].tolist(), y[similar].tolist(), strict=True):
        if (own[a] is None or own[a] != own[b]) and forest.join(a, b):
            links.append((a, b))
    return links


def similar_pairs(lines: list[str], own: list[int] | None, k: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places of similar lines, enough to connect all of them; with own, only pairs of two blocks count. Each set is compared with all
    earlier ones at once."""
    codes, starts = shingle_codes(lines, k)
    line_of = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(codes))))
    known, number = np.unique(codes, return_inverse=True)
    pairs = np.unique(line_of * np.int64(len(known)) + number)  # each line's set
    line_of, number = pairs // len(known), pairs % len(known)
    starts = np.searchsorted(line_of, np.arange(len(lines)))
    sizes = np.diff(np.append(starts, len(number)))
    block = None if own is None else np.array(own)
    label, marked, links = np.arange(len(lines)), np.zeros(len(known), bool), []
    for y in range(1, len(lines)):
        worth = label[:y] != label[y]
        if block is not None:
            worth &= block[:y] != block[y]
        worth &= np.minimum(sizes[:y], sizes[y]) >= similarity * np.maximum(sizes[:y], sizes[y]) - 1e-9
        if not worth.any():
            continue
        mine = number[starts[y] : starts[y] + sizes[y]]
        marked[mine] = True
        both = np.add.reduceat(marked[number[: starts[y]]], starts[:y], dtype=np.int64)
        marked[mine] = False
        for x in np.flatnonzero(worth & (both >= similarity * (sizes[:y] + sizes[y] - both) - 1e-9)).tolist():
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def bucket_links(k: int, similarity: float):
    """From batches sorted by cell to links (a, b) between lines, enough to connect each cell's links."""

    def run(batches):
        a, b = [], []
        held: list[tuple[list[dict], list[int | None]]] = []  # small groups
        size = n = 0

        def look(lines_of, pairs):
            for x, y in pairs:
                a.append(lines_of[x]["node"])
                b.append(lines_of[y]["node"])

        def look_at_held():
            rows = [r for g, _ in held for r in g]
            if rows:
                look(rows, similar_in_small_groups([r["text"] for r in rows], [i for i, (g, _) in enumerate(held) for _ in g], [o for _, own in held for o in own], k, similarity))

        def links():
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
            return out

        for group in runs_by_key((s for batch in batches for s in (batch.slice(i, 250) for i in range(0, batch.num_rows, 250))), "cell"):
            rows = list({r["node"]: r for r in group}.values())
            cross = rows[0]["i"] != rows[0]["j"]
            if len(rows) > SMALL:
                look(rows, similar_pairs([r["text"] for r in rows], [r["own"] for r in rows] if cross else None, k, similarity))
            elif len(rows) > 1:
                held.append((rows, [r["own"] if cross else None for r in rows]))
                size, n = size + sum(max(k, len(r["text"])) for r in rows), n + len(rows)
                if size > CHARS or n > (1 << ROW_BITS) - SMALL:
                    look_at_held()
                    held.clear()
                    size = n = 0
            if len(a) > 50_000:
                yield links()
        look_at_held()
        yield links()

    return run


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc, places array<long>): by document, the places of the lines to remove, among its lines with a word. Lines that a
    document repeats itself are not listed, only the first of them is, if it goes."""
    spark = docs.sparkSession
    texts, _ = by_id(docs, id_col, text_col)
    run, schema = line_rows(k, bands, rows)
    lines = stored(arrow_map(texts, run, schema), "lines")
    keys = [f"b{i}" for i in range(bands)]
    # a document has a line once here, so the least document's place is one value
    least = lines.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place"), *(F.min(x).alias(x) for x in keys))
    distinct = stored(least.select(F.monotonically_increasing_id().alias("node"), "doc", "place", *keys), "distinct")
    cells = distinct.select("node", F.explode(F.array(*keys)).alias("cell"))
    # most cells have one line: counting them first moves nothing but the cells
    shared = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cell").alias("k"), "n"), "cells")
    met = stored(cells.join(shared.hint("merge"), F.col("cell") == F.col("k")).select("cell", "node", "n"), "met")
    alike = met.groupBy("cell").agg(F.min("n").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all_of_them"))
    buckets = alike.groupBy("n", "least", "all_of_them").agg(F.min("cell").alias("k")).select("k")
    met = met.join(buckets.hint("merge"), F.col("cell") == F.col("k"), "left_semi")
    places = distinct.select("node", "doc", "place").join(met.select(F.col("node").alias("w")).distinct().hint("merge"), F.col("node") == F.col("w"), "left_semi")
    wanted = places.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("place", "node")).alias("lines"))
    found = arrow_map(texts.join(wanted, F.col("doc") == F.col("d")).select("text", "lines"), line_texts, "w long, text string")
    blocks = F.ceil(F.col("n") / block).cast("long")
    dealt = met.join(found.hint("merge"), F.col("node") == F.col("w")).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(F.xxhash64("cell", i, j).alias("cell"), i.alias("i"), j.alias("j"), "own", "node", "text")
    links = arrow_map(dealt.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell"), bucket_links(k, similarity), "a long, b long")
    links = stored(links, "links")
    discard(shared)
    components = stored(connected_components(links), "components")
    grouped = stored(components.join(distinct.select("node", "doc", "place"), "node").select("component", "node", "doc", "place"), "grouped")
    first = grouped.groupBy("component").agg(F.min(F.struct("doc", "place", "node")).alias("first")).select(F.col("first.node").alias("node"))
    later = grouped.join(first, "node", "left_anti").select(F.col("doc").alias("d"), F.col("place").alias("p"))
    kept = distinct.select(F.col("doc").alias("d"), F.col("place").alias("p")).join(later, ["d", "p"], "left_anti")
    gone = lines.select("doc", "place").join(kept, (F.col("doc") == F.col("d")) & (F.col("place") == F.col("p")), "left_anti")
    return gone.groupBy("doc").agg(F.collect_list("place").alias("places"))


def drop_lines(text: str | None, places: list[int]) -> tuple[str | None, int, int]:
    """The text without these of its lines with a word and without those that repeat an earlier line of its own; how many lines with a
    word it has, and how many go."""
    if not text:
        return text, 0, 0
    gone, kept, seen, at, lost = set(places), [], set(), 0, 0
    for line in text.split("\n"):
        own = normal_line(line)
        if own:
            if at in gone or own in seen:
                lost += 1
            else:
                kept.append(line)
            seen.add(own)
            at += 1
        else:
            kept.append(line)
    return "\n".join(kept), at, lost


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_cols: tuple[str, str] = ("n_lines", "n_lines_removed"), **how) -> DataFrame:
    """docs with text_col cut to the lines kept, and two counts, named by count_cols: lines with a word, and those removed; one row for
    each input row.

    Lines without a word are kept and count for nothing. Null texts stay null, texts that lose all lines become
    empty. Rows with a null id lose only lines that they repeat themselves. Ids are integers; rows that repeat an id count as one document,
    the one with the least of their texts, and are all cut at its places. Texts and ids of any size are taken. All
    columns stay; columns named like the counts are replaced. An empty table gives an empty one."""
    gone = removed_lines(docs, id_col, text_col, **how)
    doc, places_col = fresh_name(docs, "doc"), fresh_name(docs, "places")
    base = docs.drop(*count_cols)
    joined = base.join(gone.withColumnsRenamed({"doc": doc, "places": places_col}), F.col(id_col) == F.col(doc), "left").drop(doc)
    schema = base.schema.add(count_cols[0], "long").add(count_cols[1], "long")
    at = base.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, TEXTS):
                some = batch.slice(part, TEXTS)
                cut = [drop_lines(text, places or []) for text, places in zip(some.column(at).to_pylist(), some.column(some.num_columns - 1).to_pylist(), strict=True)]
                columns = list(some.columns[:-1])
                columns[at] = pa.array([x[0] for x in cut], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in cut], pa.int64()), pa.array([x[2] for x in cut], pa.int64())], names=[*some.schema.names[:-1], *count_cols])

    return arrow_map(joined, run, schema)


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with text_col cut to the lines kept, and no other change; see dedup_lines."""
    counts = fresh_name(docs, "lines"), fresh_name(docs, "lost")
    return dedup_lines(docs, id_col, text_col, counts, **how).drop(*counts)
