"""Operator 6, BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is one token that ends its encoding. An automaton over the vocabulary gives
all tokens that end at a place; the one whose pair with the last token of the prefix before it is compatible
(encoding the two together keeps them apart) is stored for the place. Following the stored tokens
back from the end gives the encoding, in time linear in the length; no merge is ever carried out.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold
from .wordbpe import Vocabulary, default_vocabulary, vocabulary

#: Most bytes of a worker's memo of pieces (an entry counts its own bytes and 220 more), and most pairs in the memo of pairs. A full memo of pieces becomes the older one,
#: which is looked up too and goes when the next is full, or at the end of the task.
MEMO_BYTES, ENTRY, PAIRS = 60_000_000, 220, 200_000
#: Texts coded at once, and their most characters (one text at least).
AT_ONCE, CHARS = 250, 2_000_000
NEVER = 1 << 60


class PrefixEncoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.made = {new: (a, b, rank) for (a, b), (rank, new) in vocab.merges.items()}
        self.rank = {pair: rank for pair, (rank, _) in vocab.merges.items()}
        self.pair_memo: dict[int, bool] = {}
        self.edge_memo: dict[tuple[int, int], tuple] = {}
        self.whole_memo: dict[int, bool] = {}
        self.inner = ahocorasick.Automaton()
        self.final = {}
        self.longest_final = 0
        for s, i in vocab.ids.items():
            if s.endswith(vocab.end) and s != vocab.end:
                self.final[s[: -len(vocab.end)]] = i
                self.longest_final = max(self.longest_final, len(s) - len(vocab.end))
            else:
                self.inner.add_word(s, (len(s), i))
        self.inner.make_automaton()
        self.stands = [False] * (max(vocab.tokens) + 1)
        for i in vocab.ids.values():
            self.stands[i] = self.whole(i)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0

    def rest(self) -> None:
        """Drops the older memo, so that a worker between tasks holds little."""
        self.older = {}

    def forget(self) -> None:
        """Empties all memos."""
        self.memo, self.older, self.memo_bytes = {}, {}, 0
        self.pair_memo.clear()

    def edges(self, token: int, side: int) -> tuple:
        """The symbols that form the right (side 1) or left (side 0) edge of a token while it is built, smallest
        first, each with the rank of the merge that ends it."""
        key = token, side
        if key not in self.edge_memo:
            chain, rank = [], NEVER
            while True:
                chain.append((token, rank))
                if token not in self.made:
                    break
                rank, token = self.made[token][2], self.made[token][side]
            self.edge_memo[key] = tuple(reversed(chain))
        return self.edge_memo[key]

    def meets(self, left: int, right: int) -> int:
        """Rank of the merge over the border when left and right are built next to each other; NEVER if none."""
        a, b = self.edges(left, 1), self.edges(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            m = self.rank.get((x, y), NEVER)
            if m < x_ends and m <= y_ends and m < NEVER:
                return m if i + 1 == len(a) and j + 1 == len(b) else -1
            if x_ends == y_ends == NEVER:
                return NEVER
            # of two equal merges the left one comes first
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the token's own string is encoded as this one token."""
        found = self.whole_memo.get(token)
        if found is None:
            if token not in self.made:
                found = True
            else:
                a, b, rank = self.made[token]
                found = self.whole(a) and self.whole(b) and self.meets(a, b) == rank
            self.whole_memo[token] = found
        return found

    def word(self, pre_token: str) -> bytes:
        """Ids of a pre-token, as int32."""
        found = self.memo.get(pre_token)
        if found is None and (found := self.older.get(pre_token)) is not None:
            self.keep(pre_token, found)
        if found is not None:
            return found
        plain = pre_token.isascii() and pre_token.isprintable()  # these bytes stand for themselves
        chars = pre_token if plain else "".join(map(self.v.alphabet.__getitem__, pre_token.encode("utf-8", "surrogatepass")))
        n = len(chars)
        whole = self.final.get(chars)
        if whole is not None and self.stands[whole]:
            ids = array("i", [whole])
        else:
            last, back = [-1] * (n + 1), [0] * (n + 1)
            last[n] = 0  # the place of the word end is for final tokens
            stands, apart, meets = self.stands, self.pair_memo, self.meets
            if len(apart) > PAIRS:
                apart.clear()
            for end, (size, token) in self.inner.iter(chars):
                end += 1
                if last[end] < 0:
                    start = end - size
                    if start:
                        key = last[start] << 20 | token
                        ok = apart.get(key)
                        if ok is None:
                            ok = apart[key] = meets(last[start], token) == NEVER
                    else:
                        ok = stands[token]
                    if ok:
                        last[end], back[end] = token, start
            for start in range(max(1, n - self.longest_final), n):
                token = self.final.get(chars[start:])
                if token is not None and stands[token] and meets(last[start], token) == NEVER:
                    last[n], back[n] = token, start
                    break
            ids, at = array("i"), n
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
        return self.keep(pre_token, ids.tobytes())

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= 64:
            if self.memo_bytes > MEMO_BYTES:
                self.older, self.memo, self.memo_bytes = self.memo, {}, 0
            self.memo_bytes += len(piece) + len(ids) + ENTRY
            self.memo[piece] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.word(piece)
        found = self.older.get(piece)
        if found is not None:
            return self.keep(piece, found)
        return self.keep(piece, b"".join([array("i", [x]).tobytes() if isinstance(x, int) else self.word(x) for x in self.v.pre_tokens(piece)]))

    def encode(self, text: str) -> bytes:
        known, make = self.memo.get, self.piece
        return b"".join([known(x) or make(x) for x in self.v.pieces(text)])


#: The owner of what workers keep between tasks of this operator.
OWNER = "bpe"


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary(path))


def forget_all() -> None:
    """Drops the encoders and vocabularies of this worker."""
    encoder.cache_clear()
    vocabulary.cache_clear()


def ids_array(coded: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def slices(batch: pa.RecordBatch, column: int):
    """The batch in parts of at most AT_ONCE rows and CHARS characters of a text column, with the texts."""
    start = 0
    while start < batch.num_rows:
        texts = batch.column(column).slice(start, AT_ONCE).to_pylist()
        stop, size = 0, 0
        while stop < len(texts) and (stop == 0 or size + len(texts[stop] or "") <= CHARS):
            size += len(texts[stop] or "")
            stop += 1
        yield batch.slice(start, stop), texts[:stop]
        start += stop


def joined(ids, tokens: dict[int, str]) -> str:
    """The token strings joined by one space; an id outside the vocabulary gives nothing."""
    try:
        return " ".join(map(tokens.__getitem__, ids))
    except KeyError:
        return " ".join(tokens[i] for i in ids if i in tokens)


def _encode(docs: DataFrame, id_col: str, text_col: str, path: str | None, decoded: bool) -> DataFrame:
    path = path or default_vocabulary()
    names = [id_col, "ids", "decoded"] if decoded else [id_col, "ids"]

    def run(batches):
        enc, tokens = encoder(path), vocabulary(path).tokens
        hold(OWNER, forget_all)
        try:
            for batch in batches:
                for some, texts in slices(batch, 1):
                    coded = [enc.encode(t) if t else b"" for t in texts]
                    columns = [some.column(0), ids_array(coded)]
                    if decoded:
                        columns.append(pa.array([joined(array("i", x), tokens) for x in coded], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            enc.rest()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>" + (", decoded string" if decoded else ""), OWNER)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id_col, ids array<int>), one for each input row, whole texts; null and empty texts give no ids.

    Each row is encoded alone, so repeats and order don't matter, and a null id stays null; other columns are ignored. Time grows with
    the length of a text, and so does memory: about 10 bytes a character beside the memos. An empty table gives an empty one. path
    names a vocabulary file that every executor has. Nothing is shuffled; a lost task is simply run again."""
    return _encode(docs, id_col, text_col, path, False)


def decode(coded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """coded with a column ``decoded``: the token strings joined by one space, special tokens included, as the
    vocabulary file sets no decoder. Null or no ids give an empty text; an id outside the vocabulary gives nothing. A column
    named decoded is replaced."""
    path = path or default_vocabulary()
    schema = coded.drop("decoded").schema.add("decoded", "string")

    def run(batches):
        tokens = vocabulary(path).tokens
        hold(OWNER, forget_all)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for part in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(part, AT_ONCE)
                texts = [joined([i for i in ids if i is not None], tokens) if ids else "" for ids in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return arrow_map(coded.drop("decoded"), run, schema, OWNER)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id_col, ids, decoded): encode, then decode what came out, in one pass over the rows."""
    return _encode(docs, id_col, text_col, path, True)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the SHA-256 of the ids in decimal, joined by one space, and of the decoded text."""
    return coded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
