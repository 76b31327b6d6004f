"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. Its tokens' spans (byte spans that tile the text) are joined with the
spans of its sections, both sorted, by binary search. A token that crosses a boundary counts for
one section only, by an explicit rule:

  "most"   the section that holds most of its bytes, of equal ones the first (the default)
  "first"  the section that holds its first byte
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedge.llm import common, tokens
from sedge.llm.bpe import byte_alphabet

RULES = ("most", "first")


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of the text of each id."""
    names = tokens.loaded(path).lib
    letters = set(byte_alphabet())
    out = np.zeros(names.get_vocab_size(), dtype=np.int64)
    special = names.get_added_tokens_decoder()
    for token, i in names.get_vocab().items():
        out[i] = len(token) if i not in special and set(token) <= letters else len(token.encode())
    return out


def lines(text: str) -> np.ndarray:
    """Starts of the lines of a text, in code points; a line has the line feed that ends it."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.flatnonzero(chars == 10) + 1
    return np.concatenate([[0], starts[starts < len(chars)]])


def allocate(lengths: np.ndarray, starts: np.ndarray, end: int, rule: str = "most") -> np.ndarray:
    """Tokens of each section. lengths: bytes of each token; starts: first byte of each section,
    ascending from 0; end: bytes of the text."""
    last = np.cumsum(lengths)
    first = last - lengths
    lo = np.searchsorted(starts, first, side="right") - 1
    if rule == "most":
        hi = np.searchsorted(starts, last - 1, side="right") - 1
        for i in np.flatnonzero(hi > lo):
            edges = np.clip(np.append(starts[lo[i] : hi[i] + 1], end if hi[i] + 1 == len(starts) else starts[hi[i] + 1]), first[i], last[i])
            lo[i] += int(np.argmax(np.diff(edges)))
    return np.bincount(lo, minlength=len(starts))


def count(docs: DataFrame, path: str, sections=lines, rule: str = "most") -> DataFrame:
    """One row a section: doc_id, section (from 0), start and end in code points, n_tokens.

    The numbers of a document add up to the tokens of its whole text, special tokens of the file in
    the text included. Null and empty texts have one empty section with no token. Rows that repeat
    a doc_id give sections each; other columns do not matter. An empty table gives an empty table.
    sections(text) returns the starts.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        coder, size = tokens.loaded(path), token_bytes(path)
        for batch in common.slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                starts = sections(text) if text else np.zeros(1, dtype=np.int64)
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                n = len(text)
                at = starts if len(raw) == n else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
                got = allocate(size[np.frombuffer(coder.encode(text), dtype="<u4")], at, len(raw), rule)
                for column, values in zip(out, ([doc_id] * len(starts), range(len(starts)), starts.tolist(), [*starts[1:].tolist(), n], got.tolist())):
                    column.extend(values)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "section", "start", "end", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
