"""Byte-level BPE encoding and decoding through a SentencePiece model made from a rank file.

The vocabulary becomes a SentencePiece BPE model without any training: byte b is the character
U+0100 + b (letters all, so nothing is taken for white space), a token of rank r is the piece of
its bytes' characters with score -r, and the normaliser is the identity. SentencePiece joins the
neighbours whose joint piece scores highest, leftmost first, which is the lowest rank first: the
rule of the rank file. A text is cut by the vocabulary's pattern and each match is encoded on its
own, so nothing is joined across matches. Ids are decoded by the inverse mapping, id to piece to bytes.

A match that is a token itself is that token, as in the rank file's own library; the model gives
the same, which the constructor checks for every token of the vocabulary.

No match goes from a character that isn't white space over to a space, so a text may be cut before a
space between two such characters, and its matches are those of the chunks. Each task keeps the chunks and the matches it has
seen in a table, which is emptied at ``table_rows`` rows; those over ``LONG`` characters aren't
kept, so memory is bounded whatever the corpus holds.
The rank file is read on the driver (under a megabyte) and its model sent with the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TABLE_ROWS = 300_000
#: Characters of texts that are encoded together.
GROUP = 1 << 20
#: Chunks and matches of more characters are encoded anew at each place.
LONG = 64
#: A chunk ends before a space that follows a character other than white space and is followed by one.
CHUNK = re.compile(r"\s*\S+(?:(?! \S)\s+\S*)*|\s+")
#: Where the characters of bytes begin.
BASE = 0x100
LETTERS = {b: chr(BASE + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``."""
    lines = (x.split() for x in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


def as_piece(token: bytes) -> str:
    """The characters that stand for bytes."""
    return token.decode("latin-1").translate(LETTERS)


def as_bytes(piece: str) -> bytes:
    """The bytes that characters stand for."""
    return bytes([ord(c) - BASE for c in piece])


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The SentencePiece model of a rank file; piece ``r + 1`` is the token of rank r, piece 0 is unknown and never used.

    Ranks must be 0, 1, 2, ... and hold every single byte; scores are 32-bit floats, exact up to 2^24.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)) or len(tokens) >= 1 << 24:
        raise ValueError("ranks must be consecutive from 0 and hold all single bytes")
    model = pb.ModelProto()
    model.trainer_spec.model_type = 2
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    model.pieces.add(piece="<unk>", type=2, score=0)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=as_piece(token), type=1, score=-float(rank))
    return model.SerializeToString()


class MatchTable:
    """Encodes whole texts match by match, and decodes ids."""

    def __init__(self, model: bytes, pattern: str, table_rows: int = TABLE_ROWS):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.bytes_of = [as_bytes(self.sp.id_to_piece(i)) for i in range(1, self.sp.get_piece_size())]
        self.rows = table_rows
        self.ids_of: dict[str, bytes] = {}  # of matches and chunks
        self.bytes_at: dict[str, bytes] = {}

    def whole_tokens(self) -> bool:
        """Whether every token of the vocabulary is encoded as itself."""
        n = len(self.bytes_of)
        return self.sp.encode([self.sp.id_to_piece(i) for i in range(1, n + 1)], num_threads=1) == [[i] for i in range(1, n + 1)]

    def learn(self, chunks: set[str]) -> list[str]:
        """Put ids and bytes of new chunks into the tables; those that are too long to stay."""
        cuts = {c: self.cut(c) for c in chunks}
        new = list({m for own in cuts.values() for m in own if m not in self.ids_of})
        of = self.bytes_of
        for m, ids in zip(new, self.sp.encode([as_piece(m.encode()) for m in new], num_threads=1), strict=True):
            tokens = [i - 1 for i in ids]
            self.ids_of[m] = pack(f"<{len(ids)}I", *tokens)
            self.bytes_at[m] = b"".join([of[i] for i in tokens])
        for c, own in cuts.items():
            if len(own) > 1:
                self.ids_of[c] = b"".join([self.ids_of[m] for m in own])
                self.bytes_at[c] = b"".join([self.bytes_at[m] for m in own])
        return [x for x in (*new, *cuts) if len(x) > LONG]

    def encode_all(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, ids as little-endian unsigned 32-bit integers and decoded bytes of each text."""
        out, at = [], 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and chars < GROUP:
                chars += len(texts[stop])
                stop += 1
            if len(self.ids_of) > self.rows:
                self.ids_of.clear()
                self.bytes_at.clear()
            chunks = [CHUNK.findall(x) for x in texts[at:stop]]
            long = self.learn({c for own in chunks for c in own if c not in self.ids_of})
            for own in chunks:
                ids = b"".join(map(self.ids_of.__getitem__, own))
                out.append((len(ids) // 4, ids, b"".join(map(self.bytes_at.__getitem__, own))))
            for x in set(long):
                del self.ids_of[x], self.bytes_at[x]
            at = stop
        return out

    def encode(self, text: str) -> tuple[int, bytes, bytes]:
        return self.encode_all([text])[0]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text)[1], dtype="<u4")

    def decode(self, ids) -> bytes:
        """The bytes of any ids of the vocabulary; ids beyond it raise an IndexError."""
        if len(ids) and min(ids) < 0:
            raise IndexError("negative id")
        return b"".join([self.bytes_of[i] for i in ids])


def vocabulary_model(path: str, pattern: str) -> bytes:
    """The model of a rank file, refused unless it encodes every token as itself."""
    model = serialise(read_ranks(path))
    if not MatchTable(model, pattern).whole_tokens():
        raise ValueError("merges by rank don't reach every token of this vocabulary")
    return model


def bpe_ids(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>, decoded binary`` of every row: the operator's full output.

    A null text counts as empty: no ids, no bytes. Repeated rows each give a row; other columns
    are left out, whatever their names.
    """
    model = vocabulary_model(ranks_path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = MatchTable(model, pattern)
        for b in batches:
            ids = [table.ids(x) for x in b[text]]
            yield pd.DataFrame({key: b[key], "ids": [i.astype("int32") for i in ids], "decoded": [table.decode(i) for i in ids]})

    return _narrow(docs, key, text).mapInPandas(run, _schema(docs, key, "ids array<int>, decoded binary"))


def bpe_texts(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from the ids of every row: the inverse of ``bpe_ids``.

    Null ids count as none. Bytes that aren't UTF-8 (ids cut within a character) become U+FFFD.
    """
    model = vocabulary_model(ranks_path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = MatchTable(model, pattern)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [table.decode([] if x is None else x).decode("utf-8", "replace") for x in b[ids]]})

    return bounded_batches(encoded).select(F.col(key), F.col(ids)).mapInPandas(run, _schema(encoded, key, "text string"))


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, from the same table.

    The ids' digest is over their little-endian unsigned 32-bit form, the other over the decoded
    bytes. A null text counts as empty and has the digests of no bytes.
    """
    model = vocabulary_model(ranks_path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = MatchTable(model, pattern)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for b in batches:
            got = table.encode_all(list(b[text]))
            yield pd.DataFrame({key: b[key], "n_tokens": [g[0] for g in got], "ids_sha256": [sha(g[1]) for g in got], "decoded_sha256": [sha(g[2]) for g in got]})

    return _narrow(docs, key, text).mapInPandas(run, _schema(docs, key, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def _schema(docs: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {docs.schema[key].dataType.simpleString()}, {rest}"
