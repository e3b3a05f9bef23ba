"""Operator 10, substring dedup over a log-structured fingerprint index.

A window is ``width`` consecutive words. Documents come in batches, in order of their ids; a word goes if a window
over it also starts earlier, in history or in the batch.

- Every window selects one of the shorter windows of ``gram`` words in it, the one with the smallest hash (the rightmost of equals), so equal
  windows select equal grams, and one hash in seven stands for all windows of a text. (A run with all of them would be 4.8 times
  as large as the text.) The windows that select one gram are consecutive; the words under them are the gram's context.
- The index is a list of immutable runs: Parquet tables, bucketed and sorted by hash, of (h, c, doc, first, n): hash of the gram, hash of its
  context, where it was first (document and first window), and how many windows it has; the newest run also tells how often its batch had a
  context, and where an earlier run has it. The texts are kept beside them, bucketed by document. A
  new batch is merge-joined with the runs. Opened again by its folder, the index goes on with the next batch.
- A context met before is a candidate with all its windows. A gram met before in another context may share some windows: those
  contexts' windows are hashed one by one, and equal ones are candidates.
- Candidates are verified word by word: neighbouring ones with one source become spans, spans are cut at the chunks of ``CHUNK`` words of their
  source, the chunks that are wanted are fetched once each, and a span with an unequal word is dropped.
- The batch's contexts become a run; those seen before are left out when runs are compacted, so the index grows with distinct
  text. When there are ``fanout`` runs, they are compacted into one before the next batch.

A hot context is one row for each map task before its shuffle, and joins that meet it can be split by adaptive
execution; what is gathered by document is bounded by the document's own length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, arrow_map, by_id, delete_path, discard, scratch_dir, shuffle_partitions, split_words, stored, tidy

WIDTH, GRAM, BATCHES, FANOUT, CHUNK = 20, 8, 2, 2, 64
#: Texts handled at once, and the bytes of text (one text at least) and the bytes hashed at once.
TEXTS, BYTES, BLOCK = 250, 500_000, 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
GRAMS = "h long, c long, doc long, first long, n int, own long"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*SPACE_CHARS.encode()]] = True


class Powers:
    """A multiplier's powers and those of its inverse modulo 2**64, as many as were needed so far, BLOCK at most."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n < len(self.up):
            return self.up[: n + 1], self.down[: n + 1]
        up, down = np.full(n + 1, self.base), np.full(n + 1, self.inverse)
        up[0] = down[0] = np.uint64(1)
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= BLOCK:
            self.up, self.down = up, down
        return up, down


_OF_BYTES, _OF_WORDS = Powers(_M3), Powers(_M1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a polynomial over its bytes), and where it starts. The data end in a space."""
    a = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    up, down = _OF_BYTES.to(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and where each text's begin (with the end of the last)."""
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join([*coded, b""])
    text_at = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data) and not _IS_SPACE[data[hi - 1]]:
            hi += 1  # a block ends with a space
        h, at = block_hashes(data[lo:hi])
        hashes.append(h)
        starts.append(at + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), text_at)


def rolled(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``size`` values, or of those that begin at these places."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for i in range(size):
        out = out * _M1 + (hashes[i : i + n] if at is None else hashes[at + i])
    return mixed(out)


def selected(hashes: np.ndarray, begins: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, text, first window, number of windows) of the grams that the windows of texts select."""
    if len(hashes) < width:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    grams = rolled(hashes, gram)
    span = width - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    place = span - 1 - np.argmin(view[:, ::-1], axis=1) + np.arange(len(view))
    inside = text[: len(view)] == text[width - 1 :]  # windows of one text
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    # a gram's windows end where the next one's begin or the text ends
    n = np.minimum(np.append(first[1:], len(view)), begins[text[first] + 1] - width + 1) - first
    up, down = _OF_WORDS.to(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes) * up[:-1], out=sums[1:])
    context = (sums[first + n + width - 1] - sums[first]) * down[first] + n.astype(np.uint64) * _M2
    return grams[place[first]], mixed(context), text[first], first - begins[text[first]], n


def first_of_equals(keys: np.ndarray) -> np.ndarray:
    """For each place, the first place with an equal key."""
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return order
    new = np.append(True, keys[order[1:]] != keys[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def parts_of(batches: Iterator, size: int = TEXTS, text: int | None = None) -> Iterator:
    """The batches in parts of at most ``size`` rows; with text, also of at most BYTES of that column, or one row."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            stop = min(size, batch.num_rows - start)
            if text is not None:
                column = batch.column(text).slice(start, stop)
                length = np.cumsum([0 if x is None else x for x in pc.binary_length(column).to_pylist()])
                stop = max(1, int(np.searchsorted(length, BYTES, "right")))
                stop = min(stop, len(length))
            yield batch.slice(start, stop)
            start += stop


def arrays(parts: list[list[np.ndarray]], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=names)


def gram_rows(width: int, gram: int):
    """From batches (doc, text) to GRAMS: the selected grams. own is where the document had the same context before, or -1."""
    kinds, names = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int64], ["h", "c", "doc", "first", "n", "own"]

    def run(batches):
        for batch in parts_of(batches, text=1):
            hashes, begins = word_hashes(batch.column(1).to_pylist())
            h, c, text, first, n = selected(hashes, begins, width, gram)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[text]
            same = first_of_equals(h ^ mixed(c) ^ mixed(text.astype(np.uint64) * _M1))
            own = np.where(same < np.arange(len(h)), first[same], -1)
            yield arrays([[x] for x in (h, c, doc, first, n, own)], kinds, names)

    return run


def covered(lo: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in a span [lo, lo + count)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.clip(lo, 0, n), 1)
    np.add.at(edges, np.clip(lo + count, 0, n), -1)
    return np.cumsum(edges[:-1]) > 0


def fields(spans, *names: str) -> list[np.ndarray]:
    """Fields of a scalar list of structs, as arrays."""
    return [spans.values.field(n).to_numpy(zero_copy_only=False) for n in names]


def window_rows(width: int):
    """From batches (doc, text, spans) to rows (w, doc, at, own): the windows of the spans, own as in gram_rows."""

    def run(batches):
        for batch in parts_of(batches, text=1):
            hashes, begins = word_hashes(batch.column(1).to_pylist())
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for i, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                own = hashes[begins[i] : begins[i + 1]]
                if len(own) < width:
                    continue
                at = np.flatnonzero(covered(*fields(spans, "first", "n"), len(own) - width + 1))
                w = rolled(own, width, at)
                same = first_of_equals(w)
                for p, x in zip(parts, (w, np.full(len(w), doc), at, np.where(same < np.arange(len(w)), at[same], -1)), strict=True):
                    p.append(x)
            yield arrays(parts, [np.int64] * 4, ["w", "doc", "at", "own"])

    return run


def merged_spans(at: np.ndarray, n: np.ndarray, source: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of windows that touch and keep their distance to one source, joined: (at, n, source, start)."""
    away = start - at
    order = np.lexsort((at, away, source))
    at, n, source, away = at[order], n[order], source[order], away[order]
    end = at + n
    new = np.ones(len(at), bool)
    same = (source[1:] == source[:-1]) & (away[1:] == away[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    far = np.maximum.accumulate(end + group * (int(end.max(initial=0)) + 1)) - group * (int(end.max(initial=0)) + 1)
    new[1:] = ~same | (at[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], far[last] - at[first], source[first], at[first] + away[first]


PIECES = "doc long, span long, at long, size int, source long, chunk long, skip int"


def piece_rows(width: int, chunk: int):
    """From batches (doc, spans (at, n, source, start)) to PIECES: merged spans, cut at the chunks of their sources."""
    kinds, names = [np.int64, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32], ["doc", "span", "at", "size", "source", "chunk", "skip"]

    def run(batches):
        for batch in parts_of(batches, 1000):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n, source, start = merged_spans(*fields(spans, "at", "n", "source", "start"))
                size = n + width - 1
                lo, hi = start // chunk, (start + size - 1) // chunk
                which = np.repeat(np.arange(len(at)), hi - lo + 1)
                number = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
                begin, stop = np.maximum(start[which], number * chunk), np.minimum((start + size)[which], (number + 1) * chunk)
                # a span is told apart by its number in the document
                for p, x in zip(parts, (np.full(len(which), doc), which, at[which] + begin - start[which], stop - begin, source[which], number, begin - number * chunk), strict=True):
                    p.append(x)
            yield arrays(parts, kinds, names)

    return run


def chunk_rows(chunk: int):
    """From batches (doc, text, chunks) to rows (doc, chunk, words): these chunks of the text."""

    def run(batches):
        for batch in parts_of(batches):
            docs, numbers, texts = [], [], []
            for doc, text, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                for k in chunks:
                    docs.append(doc)
                    numbers.append(k)
                    texts.append(b" ".join(words[k * chunk : (k + 1) * chunk]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], names=["d", "k", "words"])

    return run


def verified_cover(words: list[bytes], pieces: list[dict]) -> np.ndarray:
    """Which words are under a span whose words all equal its source's."""
    bad, good = set(), []
    for p in pieces:
        own = words[p["at"] : p["at"] + p["size"]]
        theirs = p["words"]
        if len(own) == p["size"] and (b" ".join(own) == theirs or own == theirs.split(b" ")[p["skip"] : p["skip"] + p["size"]]):
            good.append(p)
        else:
            bad.add(p["span"])
    good = [p for p in good if p["span"] not in bad]
    return covered(np.array([p["at"] for p in good], np.int64), np.array([p["size"] for p in good], np.int64), len(words))


def cut_rows(names: list[str]):
    """From batches (id, text, pieces) to (id, n_words, n_removed, kept_text): words under verified spans go."""

    def run(batches):
        for batch in parts_of(batches):
            n_words, n_removed, kept = [], [], []
            for text, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split_words(text)
                n_words.append(len(words))
                if pieces:
                    words = [w for w, g in zip(words, verified_cover(words, pieces).tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=names)

    return run


def own_key(*columns: str):
    """Copies of key columns that the planner does not know to be partitioned alike: the join then gets an exchange on this
    side too, and adaptive execution can split a hot key."""
    return [F.col(c).bitwiseXOR(F.lit(0)).alias("k_" + c) for c in columns]


def on(*columns: str):
    out = F.col(columns[0]) == F.col("k_" + columns[0])
    for c in columns[1:]:
        out = out & (F.col(c) == F.col("k_" + c))
    return out


class FingerprintIndex:
    """Runs of contexts and the texts beside them, in a folder that all executors share; add() takes a batch in and tells its repeats.

    FingerprintIndex(spark, folder) makes the index, or opens the one that is there; without a folder the index is for this job alone. Each batch's ids must be over those of all earlier ones."""

    RUN, TEXT = "h BIGINT, c BIGINT, doc BIGINT, first BIGINT, n INT, times BIGINT, old_doc BIGINT, old_first BIGINT", "doc BIGINT, text STRING"

    def __init__(self, spark, folder: str | None = None, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.width, self.gram, self.fanout = spark, width, gram, max(2, fanout)
        if not 0 < gram <= width:
            raise ValueError("a gram is part of a window")
        self.buckets = buckets or shuffle_partitions(spark)
        self.lasting = folder is not None
        self.folder = folder or f"{scratch_dir(spark)}/learnmill-index-{uuid.uuid4().hex}"
        self.runs: list[tuple[str, str]] = []  # (table, its folder)
        self.texts: list[tuple[str, str]] = []
        self.version = 0
        scratch_dir(spark)
        if self.lasting:
            self._open()

    # -- tables and the list of them

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _open(self) -> None:
        """Reads the newest whole list of tables and tells the session's catalog of them."""
        fs, path = self._files()
        versions = [int(x.getPath().getName().removeprefix("list-")) for x in fs.listStatus(path) if x.getPath().getName().startswith("list-")] if fs.exists(path) else []
        whole = [v for v in versions if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/list-{v}/_SUCCESS"))]
        if not whole:
            return
        self.version = max(whole)
        for row in sorted(self.spark.read.parquet(f"{self.folder}/list-{self.version}").collect(), key=lambda r: r["place"]):
            self.buckets, self.width, self.gram = row["buckets"], row["width"], row["gram"]
            columns, key, order = (self.RUN, "h, c", "h, c") if row["kind"] == "run" else (self.TEXT, "doc", "doc")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {row['name']} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {row['buckets']} BUCKETS LOCATION '{row['path']}'")
            (self.runs if row["kind"] == "run" else self.texts).append((row["name"], row["path"]))

    def _list(self) -> None:
        """Writes the list of tables anew; an index without a folder of its own has none."""
        if not self.lasting:
            return
        rows = [(k, i, name, path, self.buckets, self.width, self.gram) for k, tables in (("run", self.runs), ("text", self.texts)) for i, (name, path) in enumerate(tables)]
        self.spark.createDataFrame(rows, "kind string, place int, name string, path string, buckets int, width int, gram int").coalesce(1).write.parquet(f"{self.folder}/list-{self.version + 1}")
        self.version += 1

    def _write(self, rows: DataFrame, kind: str, *keys: str) -> tuple[str, str]:
        """A table bucketed and sorted by these keys, of rows that are dealt by them."""
        name = f"learnmill_{kind}_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        with tidy(self.spark):
            # hashes don't repeat enough for a dictionary
            rows.write.bucketBy(self.buckets, *keys).sortBy(*keys).format("parquet").option("path", path).option("parquet.enable.dictionary", "false").saveAsTable(name)
        return name, path

    def _drop(self, tables) -> None:
        for name, path in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)

    def _table(self, tables) -> DataFrame:
        out = self.spark.table(tables[0][0])
        for name, _ in tables[1:]:
            out = out.union(self.spark.table(name))
        return out

    def _history(self) -> DataFrame:
        """Each context of the runs once: (h, c, doc, first, n)."""
        return self._table(self.runs).where("old_doc is null").select("h", "c", "doc", "first", "n")

    def compact(self) -> None:
        """All runs become one."""
        if len(self.runs) > 1:
            known = [F.lit(None).cast("long").alias(x) for x in ("old_doc", "old_first")]
            merged = self._history().withColumns({"times": F.lit(1).cast("long")}).select("*", *known)
            old, self.runs = self.runs, [self._write(merged.repartition(self.buckets, "h", "c"), "run", "h", "c")]
            self._list()
            self._drop(old)

    def close(self) -> None:
        """Deletes the index."""
        self._drop(self.runs + self.texts)
        delete_path(self.spark, self.folder)
        self.runs, self.texts = [], []

    # -- a batch

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes in a batch (doc, text) and returns its repeated, verified pieces, PIECES with the words of their sources, by document: (doc, pieces)."""
        self.keep_texts(docs)
        candidates = self.merge(self.grams(self.spark.table(self.texts[-1][0])))
        batch = self.spark.table(self.texts[-1][0]).select(F.col("doc").alias("k_doc"))
        found = self.verify(candidates, self.unsure(newest=True))
        return found.join(batch, on("doc"), "left_semi")

    def keep_texts(self, docs: DataFrame) -> None:
        self.texts.append(self._write(docs.select("doc", "text").repartition(self.buckets, "doc"), "text", "doc"))
        self._list()

    def grams(self, texts: DataFrame) -> DataFrame:
        return arrow_map(texts.select("doc", "text"), gram_rows(self.width, self.gram), GRAMS)

    def merge(self, grams: DataFrame) -> DataFrame:
        """Merge-joins a batch's grams with the runs and makes its contexts a run. Returns candidates (doc, at, n, source, start)."""
        if len(self.runs) >= self.fanout:
            self.compact()
        grams = stored(grams, "grams")
        contexts = grams.where("own < 0").groupBy("h", "c").agg(F.min("doc").alias("doc"), F.min_by("first", "doc").alias("first"), F.min("n").alias("n"), F.count("*").alias("times"))
        history = self._history() if self.runs else None
        if history is not None:
            old = history.select(F.col("h").alias("k_h"), F.col("c").alias("k_c"), F.col("doc").alias("old_doc"), F.col("first").alias("old_first"))
            contexts = contexts.join(old.hint("merge"), on("h", "c"), "left").drop("k_h", "k_c")
        else:
            contexts = contexts.withColumns({"old_doc": F.lit(None).cast("long"), "old_first": F.lit(None).cast("long")})
        self.runs.append(self._write(contexts, "run", "h", "c"))
        self._list()
        contexts = self.spark.table(self.runs[-1][0])
        again = contexts.where("old_doc is not null or times > 1").select(*own_key("h", "c"), F.coalesce("old_doc", "doc").alias("source"), F.coalesce("old_first", "first").alias("start"))
        met = grams.where("own < 0").join(again.hint("merge"), on("h", "c")).where("doc <> source").select("doc", F.col("first").alias("at"), "n", "source", "start")
        itself = grams.where("own >= 0").select("doc", F.col("first").alias("at"), "n", F.col("doc").alias("source"), F.col("own").alias("start"))
        candidates = stored(met.union(itself), "candidates")
        discard(grams)
        return candidates

    def unsure(self, newest: bool) -> DataFrame:
        """The contexts (doc, first, n) whose windows must be compared one by one, as their gram stands in other contexts too: of all runs, or of those
        grams that the newest run has."""
        contexts = self._history()
        shared = contexts.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
        if newest:
            theirs = self.spark.table(self.runs[-1][0]).where("old_doc is null").select(F.col("h").alias("k_h")).distinct()
            shared = shared.join(theirs.hint("merge"), on("h"), "left_semi")
        shared = stored(shared.select(*own_key("h")), "shared")
        out = stored(contexts.select("h", "doc", "first", "n").join(shared.hint("merge"), on("h"), "left_semi").select("doc", "first", "n"), "unsure")
        discard(shared)
        return out

    def verify(self, candidates: DataFrame, unsure: DataFrame) -> DataFrame:
        """(doc, pieces): candidates, and equal windows of the unsure contexts, as pieces with the words to compare them with."""
        texts = self._table(self.texts)
        by_doc = unsure.groupBy(F.col("doc").alias("k_doc")).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
        windows = stored(arrow_map(texts.join(by_doc.hint("merge"), on("doc")).select("doc", "text", "spans"), window_rows(self.width), "w long, doc long, at long, own long"), "windows")
        first = windows.where("own < 0").groupBy("w").agg(F.min("doc").alias("source"), F.min_by("at", "doc").alias("start"), F.count("*").alias("times")).where("times > 1")
        later = windows.where("own < 0").join(first.select(*own_key("w"), "source", "start").hint("merge"), on("w")).where("doc <> source")
        one = F.lit(1).cast("int").alias("n")
        spans = candidates.union(later.select("doc", "at", one, "source", "start")).union(windows.where("own >= 0").select("doc", "at", one, F.col("doc").alias("source"), F.col("own").alias("start")))
        grouped = spans.groupBy("doc").agg(F.collect_list(F.struct("at", F.col("n").cast("long").alias("n"), "source", "start")).alias("spans"))
        pieces = stored(arrow_map(grouped, piece_rows(self.width, CHUNK), PIECES), "pieces")
        discard(candidates, unsure, windows)
        wanted = pieces.select(F.col("source").alias("k_doc"), "chunk").distinct().groupBy("k_doc").agg(F.collect_list("chunk").alias("chunks"))
        chunks = arrow_map(texts.join(wanted.hint("merge"), on("doc")).select("doc", "text", "chunks"), chunk_rows(CHUNK), "d long, k long, words binary")
        joined = pieces.join(chunks.select(F.col("d").alias("k_source"), F.col("k").alias("k_chunk"), "words").hint("merge"), on("source", "chunk"))
        out = stored(joined.groupBy("doc").agg(F.collect_list(F.struct("span", "at", "size", "skip", "words")).alias("pieces")), "verified")
        discard(pieces)
        return out


def cut(texts: DataFrame, pieces: DataFrame | None, id_col: str, kind: str) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) of rows (doc, text); without pieces nothing is removed."""
    if pieces is None:
        joined = texts.withColumn("pieces", F.lit(None).cast("array<struct<span:bigint,at:bigint,size:int,skip:int,words:binary>>"))
    else:
        joined = texts.join(pieces.select(F.col("doc").alias("k_doc"), "pieces").hint("merge"), on("doc"), "left")
    return arrow_map(joined.select(F.col("doc").cast(kind).alias(id_col), "text", "pieces"), cut_rows([id_col, "n_words", "n_removed", "kept_text"]), f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Rows (id_col, n_words, n_removed, kept_text), one for each input row: each word goes that a window of
    ``width`` words covers whose words also start earlier (smaller id, or same id and earlier place). Windows
    are judged on the input. kept_text has the kept words joined by one space.

    The rows are taken in ``batches`` of about equal size by id, through one index; every task has its share of each batch, as the texts are dealt by
    document. The candidates of all batches are verified together. Ids are integers of any size, as are texts. Rows that repeat an id count as one document, the one with the least
    of their texts, and each loses what its own words have of that document's repeats. Rows with a null id are kept whole and are no source for others.
    Null, empty and shorter texts lose nothing. Other columns are ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows, repeated = by_id(docs, id_col, text_col)
    index = FingerprintIndex(spark, None, width, gram, fanout)
    index.keep_texts(rows)
    texts = spark.table(index.texts[0][0])
    cuts = texts.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    edges, found = [None, *sorted(set(cuts or [])), None], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = texts if lo is None else texts.where(F.col("doc") > lo)
        found.append(index.merge(index.grams(part if hi is None else part.where(F.col("doc") <= hi))))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.union(more)
    pieces = index.verify(candidates, index.unsure(newest=False))
    discard(*found)
    if repeated:
        out = stored(cut(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), pieces, id_col, kind), "kept")
        index.close()
        discard(pieces)
        return out
    blank = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = stored(cut(texts, pieces, id_col, kind).union(cut(blank, None, id_col, kind)), "kept")
    index.close()
    discard(pieces)
    return out
