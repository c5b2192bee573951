"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The patterns of SPACED have a property that makes a text cheap to encode: some places part two pieces whatever stands
around them (Packed.starts). Texts are cut there, in one pass over the bytes of a run of texts; its distinct chunks are
found by Arrow, each that is new is encoded once by the library, and texts are joined from the chunks' ids. Offsets
follow from the bytes of the ids.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, read

#: Patterns with that property, which is theirs because a piece holds letters, numbers, other signs or
#: white space, no two of these but for a space before it and for contractions.
SPACED = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)

#: Once a worker remembers so many distinct chunks, those it has not met again since the last time go; longer ones than so many bytes are not remembered.
CHUNKS = 400_000
LONG = 64

LETTER, DIGIT, SIGN, BLANK, LINE = range(1, 6)

#: A chunk that is one piece of either pattern: letters of ASCII and Latin-1, digits or signs, after a space or none.
PIECE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each byte; 0 where it takes more than the byte to tell."""
    out = np.zeros(256, np.uint8)
    out[33:127] = SIGN
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[32], out[10] = BLANK, LINE
    return out


@lru_cache(1)
def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else 256 onwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def encoder(path: str, pattern: str):
    """A tokenizers BPE model of a rank file: each split of a token into two tokens is a merge, in rank order."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table, known = byte_table(), ranks(path)
    shown = {token: "".join(table[b] for b in token) for token in known}
    merges = [
        (shown[token[:k]], shown[token[k:]])
        for token in sorted(known, key=known.get)
        for k in range(1, len(token))
        if token[:k] in known and token[k:] in known
    ]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in known.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


def contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, null as empty, and where each value ends, from 0."""
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, "" if wide == pa.large_string() else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes of an array, given where each value ends, from 0."""
    parts = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, parts).cast(pa.binary())


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at first and have these sizes, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Packed:
    """Ids, and code-point offsets [start, end), of texts, packed as unsigned 32-bit little-endian integers.

    spaced: the model's pattern has the property of SPACED. whole: strings that are looked for in whole texts before
    the pattern is applied (added tokens); a text that holds one is encoded in one piece. Offsets need a model whose
    tokens show each byte as one character.
    """

    def __init__(self, model, spaced: bool, whole: tuple[str, ...] = (), offsets: bool = True):
        self.model, self.spaced, self.whole = model, spaced, whole
        self.tokenize = model.model.tokenize
        # what is remembered: chunks, their ids in one array, where each one's begin, how many they are, and whether it was met again
        self.chunks = pa.array([], pa.large_binary())
        self.memory, self.first, self.count, self.again = np.zeros(0, "<u4"), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        self.shown = np.array([ord(c) for _, c in sorted(byte_table().items())], "<u2")
        self.size = None
        if offsets:
            vocab = model.get_vocab(with_added_tokens=False)
            sizes = {i: len(t) for t, i in vocab.items()} | {model.token_to_id(w): len(w.encode()) for w in whole}
            self.size = np.zeros(1 + max(sizes), np.int64)
            self.size[list(sizes)] = list(sizes.values())

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in one array, where each one's begin, and how many they are.

        Those that are one piece go to the library's model as it shows bytes, all others through its whole way.
        """
        single = [PIECE(c) is not None for c in chunks]
        pieces, others = [c for c, x in zip(chunks, single) if x], [c.decode() for c, x in zip(chunks, single) if not x]
        ids, ends, tokenize = [], [0], self.tokenize
        if pieces:
            shown = self.shown[np.frombuffer(b"\n".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
            for piece in shown.split(chr(self.shown[10])):
                ids += [t.id for t in tokenize(piece)]
                ends.append(len(ids))
        for k in range(0, len(others), 1000):
            for own in self.encoded(others[k : k + 1000]):
                ids += own
                ends.append(len(ids))
        place = np.argsort(np.argsort(~np.array(single, bool), kind="stable"), kind="stable")
        return np.array(ids, "<u4"), np.array(ends)[:-1][place], np.diff(ends)[place]

    def forget(self, stay: np.ndarray) -> None:
        """Only the chunks of these places are remembered further."""
        self.chunks, self.again = self.chunks.take(pa.array(stay)), self.again[stay]
        self.memory, self.count = gathered(self.memory, self.first[stay], self.count[stay]), self.count[stay]
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts, and where two pieces meet in any text.

        That is between letters, digits, signs and white space in either order, but not after white space, which may
        belong to what follows, nor between an apostrophe and a letter; before a space or line end that stands before
        a sign, digit or letter; and between a line end and these. What a byte does not tell of itself is not cut.
        """
        kind = kinds()[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        solid = (kind > 0) & (kind <= SIGN)
        cut = np.zeros(len(data), bool)
        before, after = kind[:-1], kind[1:]
        cut[1:] = solid[:-1] & (after > 0) & (before != after) & ~((data[:-1] == ord("'")) & (after == LETTER))
        cut[1:] |= (before == LINE) & solid[1:]
        # the next text's beginning is not what a text's last space stands before
        stands = np.r_[solid[1:], False]
        stands[ends[1:][ends[1:] > 0] - 1] = False
        cut |= (kind >= BLANK) & stands
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def ids(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand in these bytes, one after another, and where each text's ids end, from 0."""
        starts = self.starts(data, ends) if self.spaced else ends[:-1]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        values = chunks.dictionary
        at = pc.fill_null(pc.index_in(values, value_set=self.chunks), -1).to_numpy().astype(int)
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        at[new] = len(self.chunks) + np.arange(len(new))
        fresh = values.take(pa.array(new))
        ids, first, count = self.learn(fresh.to_pylist())
        self.first, self.count, self.again = np.r_[self.first, len(self.memory) + first], np.r_[self.count, count], np.r_[self.again, np.zeros(len(new), bool)]
        self.memory, self.chunks = np.concatenate([self.memory, ids]), pa.concat_arrays([self.chunks, fresh])
        own = at[chunks.indices.to_numpy()]
        counts = self.count[own]
        ids = gathered(self.memory, self.first[own], counts)
        short = np.diff(contents(self.chunks)[1]) <= LONG
        if len(short) > CHUNKS:
            self.forget(np.flatnonzero(short & self.again))
            self.again[:] = False
        elif not short.all():
            self.forget(np.flatnonzero(short))
        return ids, np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends) if self.spaced else np.arange(len(ends))]

    def spans(self, data: np.ndarray, ends: np.ndarray, ids: np.ndarray, id_ends: np.ndarray) -> np.ndarray:
        """The code points [start, end) of each id in its text: those of its first and of its last byte."""
        signs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        size = self.size[ids]
        stop = np.cumsum(size)
        out = np.stack([signs[stop - size + 1] - 1, signs[stop]], 1)
        return (out - np.repeat(signs[ends[:-1]], np.diff(id_ends))[:, None]).astype("<u4")

    def arrays(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of the texts of a string column, where each text's end, and with offsets their spans; null counts as empty."""
        data, ends = contents(column)
        marked = {k for w in self.whole for k in np.flatnonzero(pc.fill_null(pc.match_substring(column, w), False).to_numpy(zero_copy_only=False)).tolist()}
        if marked:
            texts = column.to_pylist()
            ids, id_ends = self.ids(*contents(pa.array([None if k in marked else t for k, t in enumerate(texts)], pa.large_string())))
            rows = [np.array(self.encoded([texts[k]])[0], "<u4") if k in marked else ids[id_ends[k] : id_ends[k + 1]] for k in range(len(texts))]
            ids, id_ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        else:
            ids, id_ends = self.ids(data, ends)
        return ids, id_ends, None if self.size is None else self.spans(data, ends, ids, id_ends)

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        ids, ends, spans = self.arrays(pa.array(texts, pa.string()))
        return [(ids[a:b].tobytes(), b"" if spans is None else spans[a:b].tobytes()) for a, b in zip(ends, ends[1:])]


@lru_cache(4)
def packer(path: str, pattern: str) -> Packed:
    return Packed(encoder(path, pattern), pattern in SPACED)


@lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte table over the tokens as the model shows them; no model is made for it."""
    table = byte_table()
    back = {c: b for b, c in table.items()}
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = bytes(back[c] for c in "".join(table[b] for b in token))
    return out


@lru_cache(4)
def flat_pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same bytes in one array, and where each id's begin and how many they are."""
    size = np.array([len(p) for p in pieces(path)], np.int64)
    return np.frombuffer(b"".join(pieces(path)), np.uint8), np.cumsum(size) - size, size


#: Rows are taken up in runs of about so many bytes, which bounds what a worker holds at once; a longer text stands alone.
RUN = 1 << 20


def runs(batch: pa.RecordBatch, at: int):
    """Slices of a batch of about RUN bytes in the column of that place."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + RUN, "right")))
        yield batch.slice(k, stop - k)
        k = stop


def mapped(df: DataFrame, column: str, added: str, make) -> DataFrame:
    """The frame with the added columns (DDL; columns of these names are replaced); make(column) gives their arrays, run by run."""
    bounded(df.sparkSession)
    fields = StructType.fromDDL(added)
    keep = [c for c in df.columns if c not in fields.names]
    at, places = df.columns.index(column), [df.columns.index(c) for c in keep]

    def run(batches):
        for batch in batches:
            for part in runs(batch, at):
                yield pa.RecordBatch.from_arrays([part.column(k) for k in places] + make(part.column(at)), keep + fields.names)
        # workers outlive tasks; what Arrow's pool holds unused goes back
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, StructType([df.schema[c] for c in keep] + fields.fields))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds token_ids and token_spans (binary) and n_tokens.

    token_ids holds unsigned 32-bit little-endian ids, token_spans for each of them the code points [start, end) it
    comes from, packed alike; tokens that share a character share its span. Null text counts as empty: no ids.
    Columns of these names are replaced.
    """

    return mapped(docs, text, CODED, lambda texts: encoded_arrays(texts, path, pattern))


CODED = "token_ids binary, token_spans binary, n_tokens long"


def encoded_arrays(texts: pa.Array, path: str, pattern: str) -> list[pa.Array]:
    ids, ends, spans = packer(path, pattern).arrays(texts)
    return [binaries(ids.view(np.uint8), 4 * ends), binaries(spans.reshape(-1).view(np.uint8), 8 * ends), pa.array(np.diff(ends), pa.int64())]


def decoded_array(packed: pa.Array, path: str) -> pa.Array:
    table, first, size = flat_pieces(path)
    data, ends = contents(packed)
    ids = np.frombuffer(data.tobytes(), "<u4")
    stops = np.r_[0, np.cumsum(size[ids])][ends // 4]
    out = binaries(gathered(table, first[ids], size[ids]), stops)
    return pc.if_else(pc.is_valid(packed), out, pa.scalar(None, pa.binary())) if packed.null_count else out


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (binary) from token_ids; null ids give null.

    A character split over tokens comes out whole, since bytes are joined before any text is read.
    """
    return mapped(coded, "token_ids", "decoded binary", lambda packed: [decoded_array(packed, path)])


def coded(docs: DataFrame) -> DataFrame:
    """Encoded, then decoded from the ids, by one worker a task."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN

    def make(texts: pa.Array) -> list[pa.Array]:
        out = encoded_arrays(texts, path, pattern)
        return [*out, decoded_array(out[0], path)]

    return mapped(docs.select("doc_id", "text"), "text", f"{CODED}, decoded binary", make)


DIGESTS = ("token_ids", "ids_sha256"), ("decoded", "decoded_sha256"), ("token_spans", "spans_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens", *[F.sha2(c, 256).alias(to) for c, to in DIGESTS])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, spans and digests; null text counts as empty, repeated rows and null ids come back as they came."""
    return coded(docs).select("doc_id", "n_tokens", "token_ids", "token_spans", *[F.sha2(c, 256).alias(to) for c, to in DIGESTS])
