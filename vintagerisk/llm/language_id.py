"""Language identification by words first, backing off to ever shorter character n-grams.

Training counts the words of labelled texts per language. The model keeps the log frequency of each word in each
language, and of the character n-grams of those words, weighted by how often the words occur. A known word scores by
its frequencies. A word that no language knows falls back: to the longest n at which any of its n-grams is known, and
scores by the mean over the known n-grams of that length.

The fit is on a bounded sample of some `max_docs` distinct labelled texts (all, if there are fewer), drawn per language:
copies of a text, told by its 64-bit hash, count once for each language that they are labelled with. Languages with few
texts give all of them, the others an equal number each, chosen by hash. So a rare language is learned from as many
texts as there are, however large the table.

The vocabulary keeps the `max_words` words seen most in each language, and as many n-grams of each length. An item kept
for one language carries its true count in every language, and totals run over all items, so its log frequencies are
those of a model without a limit; what is left out is scored by the back-off like any unseen word. So the broadcast
model is bounded by languages x lengths x `max_words` whatever the corpus. Items are held as 64-bit hashes in sorted
arrays. Prediction reads every whole text.

Null or letterless text: `und` with score 0. Null labels teach nothing. Ties go to the language that is first in the
alphabet. No labelled text at all: every text is `und`. Repeated rows are predicted each. The result has the named key
column and the prediction; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.frames import give_back, land, pick

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
MAX_DOCS, MAX_WORDS = 20_000, 60_000


def _keys(items: Iterable[str]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(item.encode(), digest_size=8).digest() for item in items), np.uint64)


@dataclass(frozen=True)
class Rows:
    """Items by number, as a dictionary from item to number would have them: the sorted hashes take 8 bytes an item."""

    keys: np.ndarray

    def find(self, items: list[str]) -> np.ndarray:
        """Numbers of those of `items` that are known, in their order."""
        at, known = self.search(items)
        return at[known]

    def search(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each item, and whether it is known."""
        wanted = _keys(items)
        at = np.searchsorted(self.keys, wanted)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == wanted[known]
        return at, known

    def get(self, item: str) -> int | None:
        found = self.find([item])
        return int(found[0]) if len(found) else None

    def __getitem__(self, item: str) -> int:
        found = self.get(item)
        if found is None:
            raise KeyError(item)
        return found

    def __contains__(self, item: str) -> bool:
        return self.get(item) is not None

    def __len__(self) -> int:
        return len(self.keys)


@dataclass(frozen=True)
class Table:
    """Items and their log frequency in each language, a row of `logs` per item."""

    row: Rows
    logs: np.ndarray


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: Table
    grams: dict[int, Table]


def padded_grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}]+"), F.lit(0))


def _top(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` items of each language by count, then by item: the limit is applied before the shuffle and after it."""
    order = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY n DESC, item) AS place"
    return counts.selectExpr("*", order).where(F.col("place") <= most).drop("place")


def _shares(rows: dict[str, int], max_docs: int) -> dict[str, float]:
    """The share of each language's rows to draw: all of the small ones, equal numbers of the others, `max_docs` in sum."""
    left, level = max_docs, 0.0
    for k, n in enumerate(sorted(rows.values())):
        level = left / (len(rows) - k)
        if n > level:
            break
        left -= n
        level = float(n)
    return {lang: min(1.0, level / n) for lang, n in rows.items()}


def _drawn(hashed: Column, share: Column) -> Column:
    """Whether the upper 53 bits of a 64-bit hash, as a number from 0 to 1, fall under the share."""
    return F.shiftrightunsigned(hashed, 11).cast("double") < share * float(2**53)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    rows = pick(labelled, text=text, lang=lang).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("hashed", F.xxhash64("text"))
    distinct = rows.select("lang", "hashed").distinct()
    found = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    shares = labelled.sparkSession.createDataFrame([*_shares(found, max_docs).items()], "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(_drawn(F.col("hashed"), F.col("share"))).select("lang", "hashed", "text")
    # a task sends one row for each text that it drew, however many copies it read
    sample = sample.groupBy("lang", "hashed").agg(F.first("text").alias("text"))
    counts = land(sample.select("lang", F.explode(_words(F.col("text"))).alias("item")).groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n")), "words")
    marked = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    cuts = [F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda k, n=n: F.struct(F.lit(n).alias("size"), F.substr(marked, k, F.lit(n)).alias("item"))) for n in range(1, LONGEST + 1)]
    usable = [F.when(F.length(marked) >= n, c).otherwise(F.array().cast("array<struct<size:int,item:string>>")) for n, c in zip(range(1, LONGEST + 1), cuts, strict=True)]
    grams = land(counts.select("lang", "n", F.inline(F.concat(*usable))).groupBy("lang", "size", "item").agg(F.sum("n").alias("n")), "grams")
    langs = tuple(sorted(r.lang for r in counts.select("lang").distinct().collect()))
    by_size = {n: _log_frequencies(grams.where(F.col("size") == n), langs, max_words) for n in range(1, LONGEST + 1)}
    return Model(langs, _log_frequencies(counts, langs, max_words), by_size)


def _log_frequencies(counts: DataFrame, langs: tuple[str, ...], most: int) -> Table:
    """log((n + 1/2) / (total + items / 2)) in every language for each item that is among the `most` of one of them.

    n, total and items are those of all counts: the limit leaves rows of the table out and changes none.
    """
    sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    distinct = counts.select("item").distinct().count()
    kept = _top(counts, ["lang"], most).select("item").distinct()
    rows = counts.join(kept, "item", "left_semi").select("item", "lang", "n").toArrow().combine_chunks()
    coded = pc.dictionary_encode(rows["item"].combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    values = np.zeros((len(coded.dictionary), len(langs)))
    values[coded.indices.to_numpy(), pc.index_in(rows["lang"], value_set=pa.array(langs, pa.string())).to_numpy()] = rows["n"].to_numpy()
    totals = np.array([sums.get(lang, 0) for lang in langs], float)
    logs = np.log((values + 0.5) / (totals + 0.5 * max(distinct, 1)))
    keys = _keys(coded.dictionary.to_pylist())
    order = np.argsort(keys)
    return Table(Rows(keys[order]), logs[order].astype(np.float32))


class Scorer:
    """Rows of word scores; each word's is worked out once and remembered, up to a limit."""

    def __init__(self, model: Model, limit: int = 100_000) -> None:
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.met: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.model.langs)), np.float32)

    def row(self, w: str) -> np.ndarray:
        (k,) = self.places([w])
        return self.rows[k]

    def places(self, words: list[str]) -> list[int]:
        """Where the rows of distinct words stand in `rows`."""
        new = [w for w in words if w not in self.met]
        if new:
            self._meet(new)
        return [self.met[w] for w in words]

    def _meet(self, words: list[str]) -> None:
        first = len(self.met)
        self.met.update(zip(words, range(first, first + len(words)), strict=True))
        while len(self.rows) < len(self.met):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        known, inside = self.model.words.row.search(words)
        for k, w in enumerate(words):
            if not inside[k]:
                self.rows[first + k] = self.back_off(w)
        self.rows[first + np.flatnonzero(inside)] = self.model.words.logs[known[inside]]

    def back_off(self, w: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            table = self.model.grams[n]
            found = table.row.find(padded_grams(w, n))
            if len(found):
                return table.logs[found].mean(0)
        return np.zeros(len(self.model.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts or not self.model.langs or not any(c.isalpha() for w in counts for c in w):
            return UNDETERMINED, 0.0
        if len(self.met) > self.limit:
            self._forget()
        at = self.places([*counts])
        logs = np.fromiter(counts.values(), float, len(counts)) @ self.rows[at]
        best = int(logs.argmax())
        return self.model.langs[best], float(1.0 / np.exp(np.maximum(logs - logs[best], -700.0)).sum())


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score: the posterior of the predicted language under equal priors."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(1)]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", "lang_pred", "score"])

    rows = pick(docs, key=key, text=text)
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs` whose language is told with a score of `least` or more, with all their columns.

    With four languages a text of which not even a letter is known scores 0.25; a short text that two languages share
    scores about a half and stays.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(text)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)
