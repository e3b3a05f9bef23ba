"""Operator 3, benchmark decontamination by the CGK embedding.

An item leaks into a document if some passage is within ``(1 - similarity)`` x its length in word edits. Windows of
each item's own size are embedded by random walks (Chakraborty, Goldenberg and Koucky): at each step the window's
current word is written, and a random bit that depends on step and word tells whether to move to the next, so that edits
become differing places of equally long strings. For a window of n words the first 1.6 n steps are used, which end inside it
nearly always. Several walks, each sampled at a few places several times, are hashed; where a window and an item
agree in any sample, the item is compared with the passage by exact edit distance.

Walks drift apart over long strings. An item of over ``part`` words is therefore embedded in parts of equal length: of m parts one has
at most a part's share of the edits, so that a window of that part's size is within its share. With this the target, a recall of 0.95 at the
full allowance of edits of any kind, is reached at every length (measured in the tests; short of the allowance it is nearly 1).
Items whose allowance is no edit (under five words) are matched exactly by the hash of their words.

Before that, windows are passed over that cannot be near any item of their size: one edit breaks at most two pairs
and three triples of neighbouring words, so a window within d edits has at least n - 1 - 2d pairs and n - 2 - 3d triples
that the items have. This bound does not say which item, and loses nothing.

Items are the stated query set: they are streamed in blocks of at most ``block_bytes``, and each block goes over all
documents. Documents are not shuffled or collected; what is found is one row for a document and item.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_name

SIMILARITY, WALKS, SAMPLES, PLACES, PART, BLOCK_BYTES = 0.8, 6, 10, 3, 40, 4_000_000
#: Texts that are screened together.
AT_ONCE = 200
_MARKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, ASCII marks being gaps."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(round((1 - similarity) * n * 1e6) // 1_000_000)


def passage_distance(item: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Fewest edits between the item and any passage of the text, and where the passage ends; most + 1 if more."""
    row = np.arange(len(item) + 1)
    item_a, steps = np.array(item), np.arange(len(item) + 1)
    best, end = most + 1, -1
    if row[-1] <= most:
        best, end = int(row[-1]), 0
    for at, word in enumerate(text, 1):
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + (item_a != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row[-1] < best:
            best, end = int(row[-1]), at
    return best, end


class BenchmarkIndex:
    """Items as word numbers; their parts, embedded and sampled. Words outside the items are number 0. Items without a word match nothing."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES, part: int = PART, seed: int = 5):
        self.similarity, self.walks, self.samples, self.places = similarity, walks, samples, places
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.exact: dict[int, dict[tuple[int, ...], list[int]]] = {}  # by length: words -> items that allow no edit
        self.parts: list[tuple[int, int, list[int]]] = []  # item, place in it, words
        self.edits: dict[int, int] = {}  # by size of a part: most edits
        runs: list[list[np.ndarray]] = [[], []]
        for item_id, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            most = allowed(len(words), similarity)
            if not words:
                continue
            self.items.append((item_id, words))
            if not most:
                self.exact.setdefault(len(words), {}).setdefault(tuple(words), []).append(len(self.items) - 1)
                continue
            m = -(-len(words) // part)
            cuts = [len(words) * i // m for i in range(m + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                self.parts.append((len(self.items) - 1, lo, words[lo:hi]))
                self.edits[hi - lo] = max(self.edits.get(hi - lo, 0), most // m)
            for k, own in enumerate(runs, 2):
                if len(words) >= k:
                    own.append(self.hashed([np.array(words[i : len(words) - k + 1 + i]) for i in range(k)]))
        self.runs = [np.unique(np.concatenate(own)) if own else np.zeros(1, np.uint64) for own in runs]
        self.exact_keys = {n: np.sort(self.hashed([np.array([w[i] for w in own]) for i in range(n)])) for n, own in self.exact.items()}
        self.sizes = sorted(self.edits)
        self.fewest = [min((self.needed(n)[k] for n in self.sizes), default=0) for k in (0, 1)]
        random = np.random.default_rng(seed)
        longest = self.steps(max(self.sizes, default=1))
        self.salts = random.integers(1, 1 << 62, (walks, longest), dtype=np.uint64)
        self.picks = {n: random.integers(0, self.steps(n), (walks, samples, places)) for n in self.sizes}
        keys, own = [], []
        for n in self.sizes:
            some = [k for k, (_, _, w) in enumerate(self.parts) if len(w) == n]
            found = self.keys(self.embed(np.array([self.parts[k][2] for k in some], np.int64), np.arange(len(some)) * n, n), n)
            keys.append(found.reshape(-1))
            own.append(np.tile(some, len(found)))
        keys, own = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, own))
        order = np.argsort(keys, kind="stable")
        self.keys_of, self.own = keys[order], own[order].astype(np.int64)

    @staticmethod
    def steps(n: int) -> int:
        return max(1, int(1.6 * n))

    @staticmethod
    def hashed(columns: list[np.ndarray]) -> np.ndarray:
        """A 64-bit hash of each row of word numbers."""
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ (out >> np.uint64(29)) ^ c.astype(np.uint64)) * _M
        return out

    def needed(self, n: int) -> tuple[int, int]:
        """Pairs and triples of the items that a window near a part of n words has at least."""
        d = self.edits[n]
        return max(0, n - 1 - 2 * d), max(0, n - 2 - 3 * d)

    def embed(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """(walk, step, window): the words that the walks write from each start, for windows of up to ``size`` words. words
        is one text, or rows of items laid end to end that walks must not leave."""
        rows = words.ndim == 2
        ends = (starts + words.shape[1])[None, :] if rows else np.array(len(words))
        flat = np.append(words.reshape(-1), -1)
        at = np.tile(starts, (self.walks, 1))
        out = np.empty((self.walks, self.steps(size), len(starts)), np.int64)
        for step in range(out.shape[1]):
            word = flat[np.where(at < ends, at, len(flat) - 1)]
            out[:, step] = word
            bits = ((word + 2).astype(np.uint64) * _M ^ self.salts[:, step, None]) * _M >> np.uint64(63)
            at += bits.astype(np.int64)
        return out

    def keys(self, embedded: np.ndarray, n: int) -> np.ndarray:
        """(walk x sample, window): a hash of the sampled places, the size and the sample's number."""
        pick = self.picks[n]
        sampled = embedded[np.arange(self.walks)[:, None, None], pick]  # walk, sample, place, window
        key = (np.arange(self.walks * self.samples, dtype=np.uint64) + np.uint64(n << 32)).reshape(self.walks, self.samples, 1) * np.ones(embedded.shape[2], np.uint64)
        for p in range(self.places):
            key = (key ^ (sampled[:, :, p] + 2).astype(np.uint64)) * _M
            key ^= key >> np.uint64(29)
        return key.reshape(self.walks * self.samples, -1)

    @staticmethod
    def places_in(ids: np.ndarray, k: int, wanted: np.ndarray) -> np.ndarray:
        """Places where k known words in a row have one of these hashes (sorted)."""
        if len(ids) < k or not len(wanted):
            return np.zeros(0, np.int64)
        known = ids > 0
        both = known[: len(ids) - k + 1].copy()
        for i in range(1, k):
            both &= known[i : len(ids) - k + 1 + i]
        at = np.flatnonzero(both)
        run = BenchmarkIndex.hashed([ids[at + i] for i in range(k)])
        return at[wanted[np.minimum(np.searchsorted(wanted, run), len(wanted) - 1)] == run] if len(at) else at

    def runs_at(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Places where k words in a row (2 or 3) seem to be a run of an item."""
        return self.places_in(ids, k, self.runs[k - 2])

    def find_many(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(number of the text, item_id, edits, last word) of all leaks. The texts are screened together."""
        if not self.items:
            return []
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 3 for w in words])  # three gaps keep runs apart
        starts = np.concatenate([[0], np.cumsum(sizes)])
        gap = [b""] * 3
        ids = np.fromiter(map(self.number.get, chain.from_iterable(chain(w, gap) for w in words), repeat(0)), np.int64, starts[-1])
        out = []
        for n, own in self.exact.items():
            found: dict[tuple[int, int], int] = {}
            for at in self.places_in(ids, n, self.exact_keys[n]).tolist():
                for k in own.get(tuple(ids[at : at + n].tolist()), ()):
                    text = int(np.searchsorted(starts, at, "right")) - 1
                    found.setdefault((text, k), at + n - 1 - int(starts[text]))
            out += [(text, self.items[k][0], 0, last) for (text, k), last in found.items()]
        if not self.sizes:
            return out
        enough = np.ones(len(texts), bool)
        for k, fewest in zip((3, 2), self.fewest[::-1], strict=True):
            hits = np.bincount(np.searchsorted(starts, self.runs_at(ids, k), "right") - 1, minlength=len(texts))
            enough &= hits >= fewest
        return out + [(i, *found) for i in np.flatnonzero(enough).tolist() for found in self.find(ids[starts[i] : starts[i + 1] - 3])]

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, edits, place of the passage's last word) for each item that leaks into a text of these words."""
        sums, hits = [], []
        for k in (2, 3):
            flags = np.zeros(len(ids) + 1, np.int64)
            hits.append(self.runs_at(ids, k) if len(ids) >= k else np.zeros(0, np.int64))
            flags[hits[-1] + 1] = 1
            sums.append(np.cumsum(flags))  # at i: runs that start before i
        seen: dict[int, set[int]] = {}
        wanted: dict[int, np.ndarray] = {}
        longest = max(self.edits.values())
        # a window may hang over either end of the text by as many words as may be missing
        padded = np.concatenate([np.zeros(longest, np.int64), ids, np.zeros(longest, np.int64)])
        region = np.arange(-longest, len(ids) + longest)
        if any(self.fewest):  # only windows with a run of the items in them can pass
            of = hits[1] if self.fewest[1] else hits[0]
            edges = np.zeros(len(region) + 1, np.int64)
            np.add.at(edges, np.maximum(of - self.sizes[-1] + longest, 0), 1)
            np.add.at(edges, of + longest + 1, -1)
            region = region[np.cumsum(edges[:-1]) > 0]
        for n in self.sizes:
            d = self.edits[n]
            at = region[(region >= -d) & (region <= len(ids) + d - n)]
            if not len(at):
                continue
            lo, near = np.minimum(np.maximum(at, 0), len(ids)), np.ones(len(at), bool)
            for k, need, sum_of in zip((2, 3), self.needed(n), sums, strict=True):
                near &= sum_of[np.minimum(np.maximum(at + n - k + 1, 0), len(ids))] - sum_of[lo] >= need
            if near.any():
                wanted[n] = at[near]
        if not wanted:
            return []
        starts = np.unique(np.concatenate(list(wanted.values())))
        for part in range(0, len(starts), 2000):
            some = starts[part : part + 2000]
            embedded = self.embed(padded, some + longest, max(wanted))
            for n, own in wanted.items():
                own = own[(own >= some[0]) & (own <= some[-1])]
                if not len(own):
                    continue
                keys = self.keys(embedded[:, :, np.searchsorted(some, own)], n)
                lo = np.minimum(np.searchsorted(self.keys_of, keys, "left"), len(self.keys_of) - 1)
                row, column = np.nonzero(self.keys_of[lo] == keys)
                first = lo[row, column]
                last = np.searchsorted(self.keys_of, keys[row, column], "right")
                for a, z, start in set(zip(first.tolist(), last.tolist(), own[column].tolist(), strict=True)):
                    for k in self.own[a:z].tolist():
                        item, place, _ = self.parts[k]
                        seen.setdefault(item, set()).add(start - place)
        out = []
        for k, places in seen.items():
            item_id, item = self.items[k]
            most = allowed(len(item), self.similarity)
            best, end = most + 1, -1
            # the window may lie up to the allowance away, and a later part may be shifted by all edits before it
            slack = most if len(item) in self.edits else 2 * most
            own, order = set(item), sorted(places)
            cuts = [0, *(i for i in range(1, len(order)) if order[i] - order[i - 1] > slack), len(order)]
            for i, j in zip(cuts, cuts[1:], strict=False):  # places that lie close are looked at once
                lo, hi = max(0, order[i] - slack), min(len(ids), order[j - 1] + len(item) + slack)
                passage = ids[lo:hi].tolist()
                missing = own.difference(passage)
                if missing and sum(w in missing for w in item) > most:
                    continue  # each word that is missing is an edit
                edits, last = passage_distance(item, passage, most)
                if edits < best:
                    best, end = edits, lo + last - 1
            if best <= most:
                out.append((item_id, best, end))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id, text), each of at most block_bytes of text or one item; streamed, never all at once."""
    block, size = [], 0
    for row in items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        n = len(row[1].encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """Rows (id_col, item_id, edits, last_word): the items that leak into each row's whole text.

    Null and empty texts and items and items with a null id find nothing; items with equal text are found each; items of under five words are found where
    their words stand as they are. Rows are searched one by one, whole texts, so repeated rows give repeated finds and a null id stays null; other columns are
    ignored, whatever their names. An empty table of either kind gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col)
    spark = docs.sparkSession
    schema = f"`{id_col}` {kind}, item_id {item_kind}, edits int, last_word int"
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = BenchmarkIndex(shared.value, **how)
            for batch in batches:
                docs, found = batch.column(0).to_pylist(), []
                for at in range(0, len(docs), AT_ONCE):
                    found += [(docs[at + i], *f) for i, *f in index.find_many(batch.column(1).slice(at, AT_ONCE).to_pylist())]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                kinds = [batch.schema.field(0).type, pa.int64() if item_kind == "bigint" else None, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[id_col, "item_id", "edits", "last_word"])

        part = arrow_map(rows, run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that an item leaks into; all columns stay, whatever their names. Rows with a null id or text stay. If rows repeat an
    id, all of them go where one has a leak."""
    name = fresh_name(docs, "leaking")
    leaking = find_leaks(docs, items, id_col, text_col, **how).select(F.col(id_col).alias(name)).distinct()
    return docs.join(leaking, F.col(id_col) == F.col(name), "left_anti")
