"""Byte-level BPE with the tiktoken library and a local rank file: encoding and raw-byte decoding.

Long texts are cut where no match of the pattern can reach across: after an ASCII letter or digit that a blank or
line feed follows (no alternative of the pattern goes on from a visible character to a white one). A stretch
without such a place is split by the `regex` module and each match merged alone, so that the library never
searches a huge string. Null texts are empty: no ids, no bytes. Rows with equal doc_id are encoded each, other
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")
STRETCH = 1 << 16


class Codec:
    def __init__(self, rank_path: str, pattern: str, stretch: int = STRETCH):
        import regex
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.stretch = regex.compile(pattern), stretch
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.widths = np.zeros(len(self.names), np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of the text in order, and whether each is short enough for the library's own search."""
        begin = 0
        while len(text) - begin > self.stretch:
            cut = SAFE.search(text, begin + self.stretch // 2)
            end = cut.end() if cut else len(text)
            yield text[begin:end], end - begin <= 2 * self.stretch
            begin = end
        yield text[begin:], True

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.stretch:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part, short in self.stretches(text):
            if short:
                ids += self.encoding.encode_ordinary(part)
            else:
                for match in self.pattern.finditer(part):
                    ids += self.encoding._core_bpe.encode_single_piece(match[0].encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256; the ids too if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_path, pattern)
        for whole in batches:
            for batch in common.slices(whole):
                n, spelled, decoded, kept = [], [], [], []
                for text in batch.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    n.append(len(ids))
                    spelled.append(hashlib.sha256(",".join([codec.names[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spelled), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(ids: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes (binary) of rows with doc_id and ids; bytes need not be valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "text_bytes"])

    return ids.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text_bytes binary")
