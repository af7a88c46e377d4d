"""Encoding by pre-token with a bounded cache.

A byte-pair tokenizer merges inside a pre-token only, so the ids of a text are
the ids of its pre-tokens one after another. Splitting with a regular
expression and looking pre-tokens up is several times faster than a call of
the tokenizer for the text; texts with a character outside Latin-1, or with
the string of an added token, go through the library as a whole, so that
Unicode rules stay the library's own.
"""

from __future__ import annotations

import re
from functools import cache

# Classes of the characters below U+0100, and the two published split rules.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t-\r \u0085 "
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
SPLITS = {
    "byte": f"{SHORT}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
    "word": f"{SHORT}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+",
}
# How tokenizer files state these two rules.
RULES = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}},
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ]},
    },
}
BEYOND = re.compile("[^\u0000-ÿ]")

#: Longer pre-tokens are encoded each time and never kept.
LONGEST_KEPT = 48
#: Entries of a worker's cache: at most some 100 MB.
MOST_KEPT = 500_000


@cache
def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one from U+0100 on."""
    shown = [x for x in range(256) if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE]
    hidden = [x for x in range(256) if x not in shown]
    return {x: x for x in shown} | {x: 0x100 + k for k, x in enumerate(hidden)}


def kind_of(tokenizer) -> str | None:
    """Which of the split rules a tokenizer has, to the letter; None: neither, so that each text goes to the library."""
    import json

    spec = json.loads(tokenizer.to_str())
    model = spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    if not plain or any(spec.get(x) for x in ("truncation", "padding", "post_processor")):
        return None
    rule = _without_offsets({"normalizer": spec.get("normalizer"), "pre_tokenizer": spec.get("pre_tokenizer")})
    return next((kind for kind, known in RULES.items() if rule == known), None)


def _without_offsets(x):
    """Without what only moves the offsets of tokens."""
    if isinstance(x, dict):
        return {k: _without_offsets(v) for k, v in x.items() if k != "trim_offsets"}
    return [*map(_without_offsets, x)] if isinstance(x, list) else x


class Encoder:
    """Ids of texts, as packed bytes. ``known`` holds pre-tokens given from
    outside; what it lacks is encoded once and kept in a cache of at most
    ``most`` entries, which is emptied when full."""

    def __init__(self, path: str, most: int = MOST_KEPT, known: dict | None = None, lengths: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind_of(self.tokenizer)
        self.split = re.compile(SPLITS[self.kind]).findall if self.kind else None
        self.model = self.tokenizer.model
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.lengths, self.most = lengths, most
        self.known = _Kept(self, known or {})

    def whole(self, text: str):
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids) if self.lengths else self.packed(ids)

    def packed(self, ids: list[int]) -> bytes:
        from array import array

        return array(self.code, ids).tobytes()

    def piece(self, piece: str):
        """The ids of one pre-token, straight from the merges."""
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(byte_letters()))
        return len(found) if self.lengths else self.packed([x.id for x in found])

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the library has to split this text."""
        if not self.split or BEYOND.search(text) or any(x in text for x in self.added):
            return None
        return self.split(text.lower() if self.kind == "word" else text)

    def __call__(self, text: str):
        """The ids as bytes, or with ``lengths`` their number."""
        found = self.pieces(text)
        if found is None:
            return self.whole(text)
        got = map(self.known.__getitem__, found)
        out = sum(got) if self.lengths else b"".join(got)
        if len(self.known) > self.most:
            self.known.trim()
        return out


class _Kept(dict):
    def __init__(self, owner: Encoder, first: dict):
        super().__init__(first)
        self.owner, self.first = owner, first

    def __missing__(self, piece: str):
        value = self.owner.piece(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = value
        return value

    def trim(self) -> None:
        self.clear()
        self.update(self.first)


@cache
def worker_encoder(path: str, lengths: bool = False, most: int = MOST_KEPT) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return Encoder(path, most, lengths=lengths)
