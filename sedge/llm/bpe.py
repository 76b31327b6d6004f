"""BPE encoding and decoding with contiguous rank arrays.

A short word is held as two plain arrays: its parts and, beside them, the merge rank of every
part with its right neighbour (with the id that the merge makes in the low bits). The smallest rank is looked for again and again, that boundary is
deleted and only the ranks of the two neighbours are looked up anew. Words of more than LONG
parts take a heap over a linked list instead, which makes the same merges without quadratic time.
Words between white space are encoded once for each worker and kept in a dictionary of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm import common

LONG = 200
NO_RANK = 1 << 60
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # Python calls these white space, the pattern does not
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file whose words end with a suffix.

    The text between special tokens is composed (NFC), lower-cased and cut into words by the
    pattern of the file; white space vanishes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        #: left id * 2^20 + right id -> rank * 2^20 + new id
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.word_ids = common.Cache(self.word)
        self.chunk_ids = common.Cache(self.chunk)

    def merged(self, parts: list[int]) -> list[int]:
        if len(parts) > LONG:
            return self.merged_long(parts)
        find = self.merge.get
        ranks = [find(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = new = low & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(new << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = find(parts[i - 1] << 20 | new, NO_RANK)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            pair = parts[i] << 20 | parts[after[i]]
            if (m := self.merge.get(pair)) is not None:
                heapq.heappush(heap, (m, i, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] << 20 | parts[j] != pair:
                continue
            parts[i], alive[j], after[i] = m & 0xFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, keep in zip(parts, alive) if keep]

    def word(self, word: str) -> bytes:
        """Ids (4 bytes each) of a word in normal form."""
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return array("i", self.merged(parts)).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space: one word, a word and a mark, or what the pattern finds."""
        if chunk.isalpha():
            return self.word_ids[chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ",.":
            return self.word_ids[chunk[:-1]] + self.word_ids[chunk[-1]]
        return b"".join([self.word_ids[w] for w in self.words(chunk)])

    def plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letters are lowered one by one, so no final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        chunks = filter(None, _SPACE.split(text)) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunk_ids.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        if self.split is None or "<|" not in text:
            return self.plain(text)
        out: list[bytes] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<i4").tobytes())
            else:
                out.append(self.plain(part))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def names_of(path: str) -> pa.Array:
    """The token of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([names.get(i, "") for i in range(max(names) + 1)])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids array<int>`, the token ids of its whole text (null text: no ids).

    Each row is encoded for itself, so rows that repeat an id or a text have ids each. A column of
    docs named ids is replaced, all others pass through; an empty table gives an empty table. path is the tokenizer file, which every worker opens.
    """
    kept = common.without(docs, "ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        bpe = loaded(path)
        for batch in common.slices(batches):
            coded = [bpe.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with `decoded string`, the tokens of its ids joined by a space each, as a tokenizer
    file without a decoder asks for; special tokens stay. Null or no ids give an empty text, rows that
    repeat have texts each, an empty table gives an empty table."""
    kept = common.without(coded, "decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        names = names_of(path)
        for batch in common.slices(batches):
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            tokens = pa.ListArray.from_arrays(pa.array(np.asarray(ids.offsets) - ids.offsets[0].as_py(), pa.int32()), names.take(ids.flatten()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(tokens, " ")], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"))
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
