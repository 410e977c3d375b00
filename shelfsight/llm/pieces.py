"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so merges never cross
the start of a marked word and each marked word is segmented on its own. A line feed is in no
piece at all and stands alone. Every task keeps a table of the distinct chunks it has seen, asks
the library once for each, and joins ids and text back by position. The table is emptied at
``table_rows`` chunks, so memory is bounded whatever the vocabulary.

The model file is read on the driver (half a megabyte) and sent with the task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n")
TABLE_ROWS = 100_000


class ChunkTable:
    """Encodes and decodes whole texts exactly as the library does without begin or end ids."""

    def __init__(self, model: bytes, table_rows: int = TABLE_ROWS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        # type 1 is an ordinary piece, 6 a byte; others than these, unknown (2) and control (3) would match across chunks
        plain = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and all(p.type in (1, 2, 3, 6) for p in proto.pieces)
        if not plain or any(not re.fullmatch(f"{MARK}*[^{MARK}\n]*", p.piece) for p in proto.pieces):
            raise ValueError("pieces of this model can cross white-space markers")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.rows, self.seen = table_rows, {}

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: set[str]) -> None:
        if len(self.seen) > self.rows:
            self.seen = {}
        new = [c for c in chunks if c not in self.seen]
        if new:
            ids = self.part.encode(new, num_threads=1)
            self.seen.update((c, (len(i), ",".join(map(str, i)), d, i)) for c, i, d in zip(new, ids, self.part.decode(ids, num_threads=1), strict=True))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        chunks = self.chunks(text)
        self.learn(set(chunks))
        got = [self.seen[c] for c in chunks]
        first = self.whole.decode(got[0][3]) if got else ""
        return sum(g[0] for g in got), ",".join([g[1] for g in got]), first + "".join([g[2] for g in got[1:]])

    def ids(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.learn(set(chunks))
        return [i for c in chunks for i in self.seen[c][3]]


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def piece_ids(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>, decoded`` of every row: the operator's full output."""
    model = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model)
        for b in batches:
            texts = [x or "" for x in b[text]]
            yield pd.DataFrame({key: b[key], "ids": [table.ids(x) for x in texts], "decoded": [table.encode(x)[2] for x in texts]})

    return _narrow(docs, key, text).mapInPandas(run, _schema(docs, key, "ids array<int>, decoded string"))


def piece_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, from the same table.

    A null text counts as empty: no ids, and the digests of an empty string. Repeated rows each
    give a row; other columns are left out.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            got = [table.encode(x or "") for x in b[text]]
            yield pd.DataFrame({key: b[key], "n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got], "decoded_sha256": [sha(g[2]) for g in got]})

    return _narrow(docs, key, text).mapInPandas(run, _schema(docs, key, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def _schema(docs: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {docs.schema[key].dataType.simpleString()}, {rest}"
