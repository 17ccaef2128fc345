"""Exact byte-level BPE by backtracking, and decoding through an offset table.

Encoding a piece: an Aho-Corasick automaton over all tokens gives the longest token at each place. The encoder takes
it if the pair with the token before is compatible, that is, if merging in rank order would leave exactly this border
between the two; else it tries the next shorter token that is a prefix, and goes back a token if none fits. A bit per
place keeps a dead end from being tried twice, so the work is linear. The result is that of applying the merges.

Decoding: the bytes of all tokens stand in one array; a table of offsets gives each id's slice.

Null or empty text: no ids, and empty text back. The string of an added token in a text becomes that token's id.
A piece without any cut, however long, is one run of the encoder. Repeated rows are encoded each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vintagerisk.llm.chunks import ChunkedEncoder, Ids, byte_letters, gather, loaded

# fixed value: how byte-level BPE splits text into pieces
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class BacktrackingEncoder(ChunkedEncoder):
    """Ids of texts for a byte-level BPE file of the tokenizers format."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.letter = {b: letters[b] for b in range(256)}
        # own numbers: bytes first, then merges by rank, so that a smaller number is merged earlier
        number = {letter: b for b, letter in enumerate(letters)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (number[left], number[right])
            made = number.setdefault(left + right, len(self.parts))
            if made == len(self.parts):
                self.parts.append(pair)
            self.joined.setdefault(pair, made)
        texts = sorted(number, key=number.__getitem__)
        self.size = [len(t) for t in texts]
        self.out = np.array([self.vocab[t] for t in texts], np.uint32)
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), None) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(t, (k, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.added_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(self.added_ids, key=len, reverse=True)))) if self.added_ids else None
        super().__init__(self._many, self._with_added, list(self.added_ids))

    def compatible(self, left: int, right: int) -> bool:
        """Whether rank-order merging keeps the border between these two tokens; answers are kept in the pair table."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            known = self.fits[pair] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # undo the merges that touch the border, latest first; none of the pairs that meet there may merge earlier than what was undone
        bound = len(self.parts)
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < bound:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def piece(self, letters: str) -> list[int]:
        longest = [0] * len(letters)
        for end, (k, n) in self.automaton.iter(letters):
            longest[end + 1 - n] = k  # matches come by their ends, so the last one at a start is the longest
        size, shorter, compatible = self.size, self.shorter, self.compatible
        alive = bytearray(b"\x01") * (len(letters) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(letters):
            while token is not None and not (alive[at + size[token]] and (not taken or compatible(taken[-1], token))):
                token = shorter[token]
            if token is None:
                alive[at] = 0
                token = taken.pop()
                at -= size[token]
            else:
                taken.append(token)
                at += size[token]
                token = longest[at] if at < len(letters) else None
        return taken

    def _uncut(self, text: str) -> list[int]:
        ids: list[int] = []
        for p in PIECE.findall(text):
            ids += self.piece(p.encode().decode("latin-1").translate(self.letter))
        return ids

    def _many(self, chunks: list[str]) -> Ids:
        sizes, ids = [0], []
        for c in chunks:
            ids += self._uncut(c)
            sizes.append(len(ids))
        return np.array(sizes), self.out[ids]

    def _with_added(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self.out[self._uncut(text[at : m.start()])], np.array([self.added_ids[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self.out[self._uncut(text[at:])]])


class OffsetDecoder:
    """Text of ids: one byte array of all tokens, and where each token's bytes start."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        parts = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        parts |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ordered = [parts.get(i, b"") for i in range(max(parts) + 1)]
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.offset = np.cumsum([0, *map(len, ordered)])

    def __call__(self, numbers: np.ndarray, step: int = 1 << 16) -> str:
        out = []
        for k in range(0, len(numbers), step):
            n = numbers[k : k + step]
            out.append(gather(self.offset[n], self.offset[n + 1] - self.offset[n], self.bytes).tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


def _ids(texts: pa.Array, told) -> Iterator[tuple[int, pa.ListArray]]:
    """(first row, ids) of the slices of a column of texts."""
    for at, (offsets, values) in loaded(BacktrackingEncoder, told.value).batches(texts):
        yield at, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int32)))


def _texts(lists: pa.ListArray, told) -> pa.Array:
    work = loaded(OffsetDecoder, told.value)
    return pa.array([work(np.asarray(x.values)) if x.is_valid else "" for x in lists], pa.string())


def _mapped(df: DataFrame, new: dict[str, T.DataType], rows: Callable[[pa.RecordBatch, object], Iterator[tuple[int, list[pa.Array]]]], tokenizer_json: str) -> DataFrame:
    """`df` with the columns `new`, which `rows` makes slice by slice of a batch; columns of these names are replaced."""
    told = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # the size of a vocabulary file
    keep = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in keep] + [*new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, made in rows(batch, told):
                part = batch.slice(at, len(made[0]))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *made], names)

    return df.mapInArrow(run, T.StructType([*keep, *[T.StructField(n, k) for n, k in new.items()]]))


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with column `ids`, array<int>."""
    return _mapped(df, {ids: IDS}, lambda batch, told: ((at, [made]) for at, made in _ids(batch.column(text), told)), tokenizer_json)


def decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", text: str = "decoded", step: int = 256) -> DataFrame:
    """`df` with column `text` made from `ids`; special tokens are kept, null ids give empty text."""
    slices = lambda batch, told: ((k, [_texts(batch.slice(k, step).column(ids), told)]) for k in range(0, batch.num_rows, step))
    return _mapped(df, {text: TEXT}, slices, tokenizer_json)


def recode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with column `ids` of its text and column `decoded` of those ids, in one pass."""
    return _mapped(df, {ids: IDS, decoded: TEXT}, lambda batch, told: ((at, [made, _texts(made, told)]) for at, made in _ids(batch.column(text), told)), tokenizer_json)
