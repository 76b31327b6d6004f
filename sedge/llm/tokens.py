"""Token ids of whole texts under a byte-level tokenizer file, for the operators that count and pack.

Runs of non-space characters with the space before them are independent of their surroundings
under the byte-level pattern, so each different run is encoded once for each worker and kept in a
dictionary of bounded size. tiktoken encodes a run, with the vocabulary of the file as its ranks.
Texts that hold a special token, or control characters which Python alone calls white space, are
encoded whole by the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

from sedge.llm import common
from sedge.llm.bpe import byte_alphabet

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
_ODD = re.compile("[\x1c-\x1f]")
_WIDE = re.compile(r" \s")


class ByteLevel:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.plain = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.runs = common.Cache(self.run)
        self.spaced = common.Cache(self.after_space)

    def run(self, run: str) -> bytes:
        return array("I", self.plain(run)).tobytes()

    def after_space(self, run: str) -> bytes:
        if run[-1:] in (",", ".") and run[:-1].isalpha():
            return self.spaced[run[:-1]] + self.runs[run[-1]]
        return array("I", self.plain(" " + run)).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the text, little-endian and 4 bytes each; none for a null text."""
        if not text:
            return b""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if _WIDE.search(text):
            return b"".join(map(self.runs.__getitem__, _RUNS(text)))
        first, *rest = text.split(" ")  # no space is before other white space, so all runs that a cut ends are whole
        return self.run(first) + b"".join(map(self.spaced.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ByteLevel:
    return ByteLevel(path)
