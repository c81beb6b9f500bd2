"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file (its path is a parameter) becomes a tokenizers model once, on
the driver, and reaches the tasks as a broadcast of fixed size.  A task
splits texts by the pattern, merges each piece with the library, and
remembers the ids of short words, in ``HELD`` bytes at most.  Encoding gives ids and, for each token, the code points it touches: token lengths in
bytes add up to byte offsets, and the byte-to-character map of the text
turns these into character offsets, also where a character is split between
tokens.  Decoding joins the tokens' bytes; characters split over tokens come
together again there, and bytes that are no UTF-8 stay bytes.

Defined results: a null text counts as empty and gives no tokens; an unknown
or null id raises ValueError; no rows give no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import text_of

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH = 256                         # texts in an output batch
HELD = 40 << 20                     # bytes of the words and ids that a task remembers
LONGEST = 48                        # characters of a word to remember
SLOT = 120                          # bytes of an entry beside its word and ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merge into ``token``: what the merges of lower rank make of its bytes."""
    parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def load(path: str) -> tuple[str, list[bytes]]:
    """The tokenizer of a rank file as JSON, and the bytes of each id; it takes one piece of the pattern at a time."""
    ranks, letters = read_ranks(path), byte_letters()
    spelled = {token: "".join(letters[b] for b in token) for token in ranks}
    by_rank = sorted(ranks, key=ranks.get)
    merges = [(spelled[m[0]], spelled[m[1]]) for t in by_rank if len(t) > 1 and (m := _last_merge(t, ranks))]
    tokenizer = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tokenizer.to_str(), table


class Encoder(dict):
    """Ids of texts; made once in a task.  As a dict it remembers, for short words after a space, the ids as int32 bytes.

    Under PATTERN a single space before a word always begins a piece, so in a
    text without two white-space characters in a row the words can be looked
    up one by one, and only words not met before are split and merged.
    """

    def __init__(self, spec: str, pattern: str = PATTERN):
        self.model, self.pieces = Tokenizer.from_str(spec).model, regex.compile(pattern).findall
        self.by_word, self.run = pattern == PATTERN, regex.compile(r"\s\s").search
        self.letters, self.held = dict(enumerate(byte_letters())), 0

    def merge(self, text: str) -> bytes:
        spelled = (piece.encode().decode("latin-1").translate(self.letters) for piece in self.pieces(text))
        return array("i", [token.id for piece in spelled for token in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(" " + word)
        if len(word) <= LONGEST:
            size = getsizeof(word) + getsizeof(ids) + SLOT
            if self.held + size > HELD:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += size
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word or self.run(text):
            return np.frombuffer(self.merge(text), dtype=np.int32)
        first, *words = text.split(" ")
        return np.frombuffer(self.merge(first) + b"".join(map(self.__getitem__, words)), dtype=np.int32)


def char_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point that each token touches, and the one after its last."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return char_of_byte[ends - lengths[ids]], char_of_byte[ends - 1] + 1


def _with(batch: pa.RecordBatch, drop: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *columns.values()], [*names, *columns])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0)]), kind))


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, table: list[bytes], text: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder, lengths = Encoder(spec, pattern), np.array([len(t) for t in table])
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = [encoder(t) for t in texts]
            spans = [char_spans(t, i, lengths) if len(i) else (i, i) for t, i in zip(texts, ids)]
            yield _with(batch, text, {"ids": _lists(ids, pa.int32()), "starts": _lists([a for a, _ in spans], pa.int32()),
                                      "ends": _lists([b for _, b in spans], pa.int32())})


def _decoded(ids: pa.Array, table: list[bytes]) -> pa.Array:
    found = []
    for tokens in ids:
        own = tokens.values.to_numpy(zero_copy_only=False).tolist() if tokens.is_valid else []
        try:
            if min(own, default=0) < 0:
                raise IndexError
            found.append(b"".join([table[i] for i in own]))
        except (IndexError, TypeError) as e:
            raise ValueError("an id is null or not in the vocabulary") from e
    return pa.array(found, pa.binary())


def encode(rows: DataFrame, path: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``rows`` without the column ``text``, plus ids, starts and ends (code points, end exclusive); columns of these names are replaced."""
    rows = rows.drop(*{"ids", "starts", "ends"} - {text})
    given = rows.sparkSession.sparkContext.broadcast(load(path))
    empty = F.array().cast("array<int>")
    schema = rows.drop(text).withColumns({"ids": empty, "starts": empty, "ends": empty}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, *given.value, text, pattern)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` without the column ``ids``, plus ``decoded``, the bytes that the ids stand for; a column of this name is replaced."""
    rows = rows.drop(*{"decoded"} - {ids})
    given = rows.sparkSession.sparkContext.broadcast(load(path))
    schema = rows.drop(ids).withColumn("decoded", F.lit(b"").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, ids, {"decoded": _decoded(batch.column(batch.schema.get_field_index(ids)), given.value[1])})

    return rows.mapInArrow(run, schema)


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Encoding and decoding share one Python worker: the tokens go from one to the other without a second worker a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encoded(batches, *given.value, "text", PATTERN):
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), ids, _decoded(ids, given.value[1])],
                                             ["doc_id", "ids", "decoded"])

    tokens = rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))
