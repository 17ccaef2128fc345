"""Token ids of whole texts, encoding each distinct chunk of a batch once.

A text is cut at each space that a non-space character follows. The pre-tokenizers of the supported files always
start a new piece there, so the ids of a text are its chunks' ids in a row. Chunks repeat: Arrow splits a batch and
numbers its distinct chunks, only these are encoded, and the ids are gathered back by number. Of a chunk that is a word with punctuation behind it (no apostrophe first), the two are encoded
apart, since a piece always ends between them, and so are a line's end and a word that follow. A text that holds the
string of an added token is never cut. A batch is worked on in slices of some megabytes, or of one longer text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_RUN = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
CUT = re.compile(r" (?=\S)")
TAIL = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)(?:(\n)([^\W\d_]+))?")
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")  # what a TAIL without a second line ends with
Ids = tuple[np.ndarray, np.ndarray]  # offsets (one more than texts), ids


def gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] of all i in a row."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


def joined(parts: list[np.ndarray]) -> Ids:
    return np.cumsum([0, *map(len, parts)]), np.concatenate([np.empty(0, np.uint32), *parts])


class ChunkedEncoder:
    """encode_many: ids of texts, each for itself. whole: ids of one text that must not be cut. limit: chunks remembered."""

    def __init__(self, encode_many: Callable[[list[str]], Ids], whole: Callable[[str], np.ndarray], added: list[str], limit: int = 500_000) -> None:
        self.encode_many, self.whole, self.added, self.limit = encode_many, whole, added, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _add(self, chunks: list[str], offsets: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(chunks)), strict=True))
        self.offsets = np.concatenate([self.offsets, len(self.ids) + offsets[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def _of_distinct(self, chunks: list[str]) -> np.ndarray:
        """Places of the chunks in `offsets`."""
        missing = [c for c in chunks if c not in self.known]
        if len(self.known) + 2 * len(missing) > self.limit:
            self._forget()
            missing = chunks
        if missing:
            cuts = [TAIL.fullmatch(c) if c[-1:] in MARKS or "\n" in c else None for c in missing]
            parts = [p for m in cuts if m for p in m.groups("")]
            uncut = [c for c, m in zip(missing, cuts, strict=True) if not m]
            new = [p for p in dict.fromkeys([*parts, *uncut]) if p not in self.known]
            if new:
                self._add(new, *self.encode_many(new))
            if parts:
                row = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
                at, size = self.offsets[row], self.offsets[row + 1] - self.offsets[row]
                self._add([c for c, m in zip(missing, cuts, strict=True) if m], np.r_[0, np.cumsum(size)][::4], gather(at, size, self.ids))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def _of_lists(self, lists: pa.ListArray) -> Ids:
        """The first chunk of each list stands at a text's start, all others follow a space."""
        starts, flat = np.asarray(lists.offsets, np.int64), lists.values
        coded = flat.dictionary_encode()
        number = np.asarray(coded.indices, np.int64)
        first = np.zeros(len(number), bool)
        first[starts[:-1]] = True
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        seen = np.zeros((2, len(words)), bool)
        seen[0, number[~first]] = seen[1, number[first]] = True
        led, heads = np.flatnonzero(seen[0]), np.flatnonzero(seen[1])
        place = np.empty((2, len(words)), np.int64)
        chunks = self._of_distinct([" " + w for w in words[led]] + list(words[heads]))
        place[0, led], place[1, heads] = chunks[: len(led)], chunks[len(led) :]
        row = place[first.view(np.int8), number]
        at = self.offsets[row]
        size = self.offsets[row + 1] - at
        return np.r_[0, np.cumsum(size)][starts], gather(at, size, self.ids)

    def _slice(self, texts: pa.Array) -> Ids:
        odd = np.asarray(pc.match_substring_regex(texts, SPACE_RUN).to_numpy(zero_copy_only=False), bool)
        uncut = np.zeros(len(texts), bool)
        for a in self.added:
            uncut |= np.asarray(pc.match_substring(texts, a).to_numpy(zero_copy_only=False), bool)
        groups: list[tuple[np.ndarray, Ids]] = []
        plain, spaced, special = (np.flatnonzero(m) for m in (~odd & ~uncut, odd & ~uncut, uncut))
        if len(plain):
            groups.append((plain, self._of_lists(pc.split_pattern(texts.take(pa.array(plain)), " "))))
        if len(spaced):
            groups.append((spaced, self._of_lists(pa.array([CUT.split(texts[i].as_py()) for i in spaced.tolist()], pa.list_(pa.string())))))
        if len(special):
            own = [self.whole(texts[i].as_py()) for i in special.tolist()]
            groups.append((special, joined(own)))
        if len(groups) == 1:
            return groups[0][1]
        start, size, shift = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), 0
        for rows, (offsets, ids) in groups:
            start[rows], size[rows] = offsets[:-1] + shift, np.diff(offsets)
            shift += len(ids)
        return np.r_[0, np.cumsum(size)], gather(start, size, np.concatenate([ids for _, (_, ids) in groups]))

    def batches(self, texts: pa.Array, step_bytes: int = 1 << 22) -> Iterator[tuple[int, Ids]]:
        """(first row, ids) of the slices of a column of texts; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, "right")))
            yield at, self._slice(texts.slice(at, to - at))
            at = to
        pa.default_memory_pool().release_unused()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free letter from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(spare)) for b in range(256)]


class LibraryEncoder(ChunkedEncoder):
    """encode(text, add_special_tokens=False) of a tokenizers file.

    A chunk that is one word of plain Latin letters is one piece whatever stands around it; where the file's normalizer
    does no more than lower its case, it goes to the library's model directly. All others take the whole path.
    """

    LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))  # besides the ASCII ones
    WORD = rf"\A ?[A-Za-z{LETTERS}]+\z"  # Arrow's regular expressions

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(tokenizer_json)
        added = spec["added_tokens"]
        # a chunk never holds an added token, so one that takes no space to its sides can stand between chunks
        self.between = next((t for t in added if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])), None)
        self.model = self.tokenizer.model
        self.forms = self._word_forms(spec)
        super().__init__(self._many, self._one, [t["content"] for t in added])

    def _word_forms(self, spec: dict) -> Callable[[str], str] | None:
        """How the model gets plain words, one a line, for the two kinds of files known; None for others."""
        before, cuts = spec["normalizer"], spec["pre_tokenizer"]
        steps = [n["type"] for n in before["normalizers"]] if before and before["type"] == "Sequence" else [before and before["type"]]
        parts = cuts["pretokenizers"] if cuts["type"] == "Sequence" else [cuts]
        kinds = [c["type"] for c in parts]
        shown = dict(enumerate(byte_letters()))
        # the letter that all others' forms begin with comes first, so that no form is taken for a letter
        pairs = [(c, c.encode().decode("latin-1").translate(shown)) for c in " Ã" + self.LETTERS.replace("Ã", "")]

        def bytewise(lines: str) -> str:
            for letter, form in [] if lines.isascii() and " " not in lines else pairs:
                lines = lines.replace(letter, form)
            return lines

        if steps == [None] and kinds == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            return bytewise
        if steps == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"]:
            return lambda lines: bytewise(lines.replace(" ", "").lower())
        return None

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _many(self, chunks: list[str]) -> Ids:
        if self.forms is None:
            return self._whole_path(chunks)
        plain = pc.match_substring_regex(pa.array(chunks, pa.string()), self.WORD).to_numpy(zero_copy_only=False)
        found, ends = [], [0]
        for word in self.forms("\n".join(chunks[k] for k in np.flatnonzero(plain).tolist())).split("\n") if plain.any() else []:
            found += [t.id for t in self.model.tokenize(word)]
            ends.append(len(found))
        own = np.array(found, np.uint32)
        others, rest = self._whole_path([chunks[k] for k in np.flatnonzero(~plain).tolist()])
        start, size = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        start[plain], size[plain] = ends[:-1], np.diff(ends)
        start[~plain], size[~plain] = others[:-1] + len(own), np.diff(others)
        return np.r_[0, np.cumsum(size)], gather(start, size, np.concatenate([own, rest]))

    def _whole_path(self, chunks: list[str]) -> Ids:
        if self.between is None:
            return joined([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])
        sizes, ids = [], [np.empty(0, np.uint32)]
        mark, number = self.between["content"], self.between["id"]
        for k in range(0, len(chunks), 1024):
            found = np.array(self.tokenizer.encode_batch_fast([mark.join([*chunks[k : k + 1024], ""])], add_special_tokens=False)[0].ids, np.uint32)
            sizes.append(np.diff(np.flatnonzero(found == number), prepend=-1) - 1)
            ids.append(found[found != number])
        return np.concatenate([[0], *sizes]).cumsum().astype(np.int64), np.concatenate(ids)


_LOADED: dict[str, tuple[str, object]] = {}


def loaded(kind: type, tokenizer_json: str) -> object:
    """One object of each kind per Python worker, which Spark uses again for further tasks."""
    known = _LOADED.get(kind.__name__)
    if known is None or known[0] != tokenizer_json:
        known = _LOADED[kind.__name__] = (tokenizer_json, kind(tokenizer_json))
    return known[1]
