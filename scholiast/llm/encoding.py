"""Token ids of a corpus under a public byte-level BPE, by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so a text
may be cut between the two bytes: encoding the fragments one by one and concatenating
their ids gives the ids of the whole. Cuts are made on two levels. A text is first cut
before each run of white space, where the pre-tokenizer begins anew whatever stands
before; the fragments, mostly single words, are looked up in a table of fragments seen.
An unseen fragment is pre-tokenized, and each of its pieces is cut at every forced
boundary before the byte pairs that remain are merged.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholiast.runtime import spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer's pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters with the Unicode property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FRAGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def joined_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """joined[a, b]: whether the bytes a, b stand side by side inside some token."""
    joined = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        t = np.frombuffer(token, dtype=np.uint8)
        joined[t[:-1], t[1:]] = True
    return joined


@lru_cache(4)
def encoder(path: str = VOCABULARY, memo: int = 300_000) -> Callable[[str | None], array]:
    """A function from text to its ids; memo bounds the number of fragments kept, not what is encoded."""
    import regex
    import tiktoken

    ranks = load_ranks(path)
    bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    joined, pieces = joined_pairs(ranks), regex.compile(PATTERN)
    ordinary = bpe._encode_single_piece
    seen: dict[str, array] = {}

    def fragment_ids(fragment: str) -> array:
        ids = array("i")
        for piece in pieces.findall(fragment):
            raw = piece.encode("utf-8")
            if (whole := ranks.get(raw)) is not None:
                ids.append(whole)
                continue
            b = np.frombuffer(raw, dtype=np.uint8)
            cuts = [0, *(np.flatnonzero(~joined[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
            for start, end in zip(cuts, cuts[1:]):
                part = raw[start:end]
                one = ranks.get(part)
                ids.extend([one] if one is not None else ordinary(part))
        return ids

    def encode(text: str | None) -> array:
        ids = array("i")
        if text:
            for fragment in _FRAGMENT.findall(text):
                known = seen.get(fragment)
                if known is None:
                    known = fragment_ids(fragment)
                    if len(fragment) <= 48:  # longer ones seldom come back, and would fill the memory
                        if len(seen) >= memo:
                            seen.clear()
                        seen[fragment] = known
                ids.extend(known)
        return ids

    return encode


def with_ids(df: DataFrame, text: str, keep: list[str], out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and the token ids of a text column.

    Null and empty texts give an empty list; blank and very long texts are encoded whole;
    strings of special tokens are ordinary text. Columns other than those kept are not read.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for x in b.column(len(keep)).to_pylist():
                flat.extend(encode(x))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], ids], names=[*keep, out])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def with_token_count(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and the number of tokens of a text column; 0 for null and empty texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", `{out}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            counts = pa.array([len(encode(x)) for x in b.column(len(keep)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], counts], names=[*keep, out])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", ["doc_id"])
