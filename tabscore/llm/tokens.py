"""Ids of the public byte-level BPE vocabulary, as the tokenizers library gives them, from a cache of words."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

import numpy as np

class _Edge(Exception):
    """A word has white space at its edge, so it can't be told from its neighbours."""


class _Words(dict):
    """The ids, as bytes of 16-bit numbers, of a word with the space before it; forgets them when there are too many."""

    def __init__(self, whole, limit: int):
        super().__init__()
        self.whole, self.limit = whole, limit

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Edge
        ids = array("H", self.whole(" " + part)).tobytes()
        if len(part) < 40:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids


class ByteBPE:
    """Encodes whole texts. A word with the space before it is split off and merged alone by the vocabulary's rules, so
    its ids are the same wherever it stands; texts with other white space at a word's edge are encoded whole. A text
    that holds an added token of the vocabulary's JSON goes to the named tokenizer, which gives the token its own id. A
    vocabulary without a JSON has no added tokens."""

    def __init__(self, name: str = "byte_bpe_50k", words: int = 300_000):
        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json, added = public.path(f"{name}.json"), ()
        if os.path.exists(self.json):
            with open(self.json, encoding="utf-8") as file:
                added = json.load(file).get("added_tokens", ())
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known, self.tokenizer = _Words(self.whole, words), None

    def named(self, text: str) -> list[int]:
        """The ids of the named tokenizer at its defaults, but for special tokens of its own."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> list[int]:
        try:
            return self.plain.encode_ordinary(text)
        except BaseException as e:  # the fast library gives up on very long runs of one kind
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if os.path.exists(self.json):
                return self.named(text)
            middle = len(text) // 2  # no other library has this vocabulary: a run that is too long is cut
            return self.whole(text[:middle]) + self.whole(text[middle:])

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, as unsigned 16-bit numbers."""
        if not text:
            return np.empty(0, np.uint16)
        if self.added.search(text):
            return np.array(self.named(text), np.uint16)
        first, *rest = text.split(" ")
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                rest = b"".join(map(self.known.__getitem__, rest))
                return np.frombuffer(array("H", self.whole(first)).tobytes() + rest, np.uint16)
            except _Edge:
                pass
        return np.array(self.whole(text), np.uint16)


class PieceBPE:
    """Counts, word by word (pieces don't cross white space), the bytes that a vocabulary has no other piece for."""

    def __init__(self, name: str = "piece_bpe_32k"):
        import public_tokenizers as public
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{name}.model"))
        self.single = {i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i)}
        # Words of these characters alone never have a byte piece, and need not be encoded.
        known = [c for c in map(chr, range(0x21, 0x7F)) if self.single.isdisjoint(self.pieces.encode(c))]
        self.foreign = re.compile(f"[^{re.escape(''.join(known))}]".encode()).search

    def bytes_of(self, words: list[bytes]) -> list[int]:
        """Each word's bytes that are pieces of their own."""
        out = [0] * len(words)
        some = [i for i, w in enumerate(words) if self.foreign(w)]
        for i, ids in zip(some, self.pieces.encode([words[i].decode("utf-8", "replace") for i in some], num_threads=1) if some else (), strict=True):
            if not self.single.isdisjoint(ids):
                out[i] = sum(map(self.single.__contains__, ids))
        return out
