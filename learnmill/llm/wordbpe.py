"""Parts that the two tokenizer operators share: reading a BPE vocabulary file with word ends, and cutting a
text to pre-tokens as the vocabulary file's own settings say (special strings, NFC, white space, lower case,
pattern, byte alphabet)."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

#: The pattern of pre-tokens, and characters that Unicode does not count as white space but str.split() does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_SPACE = "\x1c\x1d\x1e\x1f"
WHITE_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
PRE_TOKEN = regex.compile(PATTERN.replace(r"\s", r"\t-\r \x85\xa0  -     　"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next of those from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """ids: token string -> id; tokens: id -> string; merges: (left id, right id) -> (rank, merged id)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>", "a BPE vocabulary with word ends is needed"
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: s for s, i in (self.ids | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.alphabet = byte_alphabet()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def symbols(self, pre_token: str) -> list[int]:
        """Ids of the single bytes of a pre-token, the last with its word end."""
        chars = [self.alphabet[b] for b in pre_token.encode("utf-8", "surrogatepass")]
        chars[-1] += self.end
        return [self.ids[c] for c in chars]

    def pieces(self, text: str) -> list[str]:
        """White-space separated pieces of a text, normalised. A special string is a piece of its own, after a newline."""
        if self.special_pattern and "<|" in text and self.special_pattern.search(text):
            return [y for x in self.special_pattern.split(text) if x for y in (["\n" + x] if x in self.special else self.pieces(x))]
        text = normal(text)
        if any(c in text for c in NOT_SPACE):
            return [x for x in WHITE_SPACE.split(text) if x]
        return text.split()

    def pre_tokens(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece; a special string comes as its id."""
        return [self.special[piece[1:]]] if piece[0] == "\n" else PRE_TOKEN.findall(piece)


def normal(text: str) -> str:
    """NFC, then lower case character by character: a final sigma is no special case."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
