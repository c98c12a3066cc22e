"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that lies inside no token of the vocabulary can never be merged across, so a cut
between the two is certain: what is left of it and what is right of it are merged independently. The
table of such pairs comes from the vocabulary alone. It cuts twice:

* A text is cut, about every 2 KB, where white space follows another byte and that pair is forced; the
  pre-tokenizer starts a new piece there whatever stands around it (or, after other Unicode white space,
  groups pieces differently but only across the forced pair), so these parts are pre-tokenized by themselves.
* Every piece of the pre-tokenizer is cut at every forced pair. Each fragment is merged by itself, by tiktoken's
  merge of one piece with the vocabulary's ids as ranks, and the ids of the fragments are concatenated. A worker
  keeps the ids of the short pieces that it has seen.

The vocabulary is the tokenizers library's JSON file; its tokens and merges are in an alphabet that has one
character for each byte. Pieces are that library's too, as its Unicode tables decide what a letter is; up to
U+0500, where all tables agree, the same pattern finds them faster.

``encode`` adds ``ids`` (token ids as little-endian unsigned 32-bit integers) and ``n_tokens``;
``decode`` turns ids back to text. Both are row-local: no shuffle, memory bounded by an Arrow batch.

Defined cases: a null text is empty and has no tokens; the vocabulary's special token's string in a
text is one special token, as the tokenizers library has it by default; bytes that aren't valid UTF-8
after decoding become U+FFFD; other columns pass through, ``ids`` and ``n_tokens`` are replaced; an
empty table stays empty.
"""

from __future__ import annotations

import functools
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import read_table, ship

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AGREED = "\u0500"
#: A text is cut at the first certain cut after so many bytes.
FRAGMENT = 2048
#: A worker keeps the ids of so many pieces, up to so many bytes each; it starts anew beyond.
KEPT, SHORT = 200_000, 48
#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 200
SPACE = b" \t\n\r\x0b\x0c"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def alphabet() -> list[str]:
    """The file format's character for each byte: itself where it is a visible one of Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Known(dict):
    """Ids of pieces, made where they are first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class ForcedBoundaryBpe:
    """The vocabulary and merges of a file, with the table of forced pairs."""

    def __init__(self, path: str, fragment: int = FRAGMENT):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.byte_of = byte_of = {c: b for b, c in enumerate(alphabet())}
        self.by_library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.by_pattern = regex.compile(PATTERN).findall
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Pairs that some token holds; a cut between any other two is certain.
        self.inside = {t[k : k + 2] for t in vocabulary for k in range(len(t) - 1)}
        self.tokens: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()], default=-1) + 1)
        for token, k in vocabulary.items():
            self.tokens[k] = bytes(map(byte_of.__getitem__, token))
        for text, k in self.special.items():
            self.tokens[k] = text.encode()
        # ids follow the merges' order here, so they are ranks
        ranks = {self.tokens[k]: k for k in vocabulary.values()}
        self.merger = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self._piece_ids)
        # cut before white space that follows any other byte, where no token holds that pair
        self.chars = chars = alphabet()
        unforced = bytes(b for b in range(256) if b not in SPACE and any(chars[b] + chars[x] in self.inside for x in SPACE))
        space, before = re.escape(SPACE), re.escape(SPACE + unforced)
        self.parts = re.compile(rb"(?s:.{%d}.*?[^%s](?=[%s])|.+)" % (fragment, before, space)).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def fragments(self, piece: str) -> list[str]:
        """A pre-tokenizer's piece, in the file's alphabet, cut at every forced pair."""
        at = [k for k in range(1, len(piece)) if piece[k - 1 : k + 1] not in self.inside]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def merged(self, fragment: str) -> list[int]:
        """Ids of one fragment, from nothing but itself."""
        return self.merger._encode_single_piece(bytes(map(self.byte_of.__getitem__, fragment)))

    def _piece_ids(self, piece: str) -> bytes:
        chars = "".join(map(self.chars.__getitem__, piece.encode()))
        return _packed([k for x in self.fragments(chars) for k in self.merged(x)])

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or max(text) < AGREED:
            return self.by_pattern(text)
        return [text[a:b] for _, (a, b) in self.by_library(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_split and any(s in text for s in self.special):
            parts = enumerate(self.special_split(text))
            return b"".join(_packed([self.special[x]]) if k % 2 else self._ordinary(x) for k, x in parts)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.known.__getitem__, self.pieces(x.decode()))) for x in self.parts(text.encode())])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@functools.cache
def load(path: str) -> ForcedBoundaryBpe:
    """The vocabulary of a file, once for each worker."""
    return ForcedBoundaryBpe(path)


def _mapped(df: DataFrame, fields: list[T.StructField], column: str, make) -> DataFrame:
    names = {f.name for f in fields}
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + fields)
    rest = [f.name for f in df.schema.fields if f.name not in names]

    def run(batches):
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), ROWS):  # whole texts, few at a time
                part = batch.slice(start, ROWS)
                new = make(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in rest] + new, names=rest + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with ``ids`` (binary) and ``n_tokens`` (long)."""
    ship(df.sparkSession)
    where = path or vocabulary_path()

    def make(column):
        bpe = load(where)
        ids = [bpe.encode(t.as_py() or "") for t in column]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(df, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], text, make)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with ``decoded``, the text that the ids stand for."""
    ship(df.sparkSession)
    where = path or vocabulary_path()

    def make(column):
        bpe = load(where)
        return [pa.array([bpe.decode(x.as_py() or b"") for x in column], pa.string())]

    return _mapped(df, [T.StructField("decoded", T.StringType())], ids, make)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with ``ids``, ``n_tokens`` and ``decoded``, by one Python worker a task: what encode and then decode give."""
    ship(df.sparkSession)
    where = path or vocabulary_path()

    def make(column):
        bpe = load(where)
        ids = [bpe.encode(t.as_py() or "") for t in column]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(bpe.decode, ids)), pa.string())]

    return _mapped(df, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())], text, make)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of rows with ids, n_tokens and decoded."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(round_trip(docs))


QUERIES = {"op3_forced_boundary_bpe": op3_forced_boundary_bpe}
#: SQL can't merge by rank; the tests hold it against the tokenizers library.
ORACLES: dict[str, str] = {}
