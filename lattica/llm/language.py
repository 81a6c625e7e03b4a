"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import ship, tidied

SPACE = 32
#: Letter vectors that a worker remembers, and distinct trigrams bound at once.
LETTERS, AT_ONCE = 20_000, 4096
#: Bytes of texts whose trigrams are summed together.
LEARNED_AT_ONCE = 2_000_000


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Space:
    """Random bipolar letter vectors of ``size`` components, drawn from the seed and the letter alone."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        found = self.known.get(code)
        if found is None:
            if len(self.known) >= LETTERS:
                self.known.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.size, dtype=np.int8)
            found = self.known[code] = 2 * bits - 1
        return found

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors times their counts; a trigram's is the product of its letters' vectors, rotated by two, one and no places."""
        total = np.zeros(self.size)
        for k in range(0, len(grams), AT_ONCE):
            g = grams[k : k + AT_ONCE]
            triples = (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF)
            letters, where = np.unique(np.concatenate(triples), return_inverse=True)
            table = np.array([self.letter(int(c)) for c in letters])
            a, b, c = where.reshape(3, -1)
            bound = np.roll(table, 2, 1)[a]
            bound *= np.roll(table, 1, 1)[b]
            bound *= table[c]
            total += counts[k : k + AT_ONCE].astype(np.float32) @ bound.astype(np.float32)
        return total


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters of a whole text, runs of anything else being one space, with their counts. None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    codes = np.where(_alphabetic()[codes], codes, SPACE)
    codes = np.concatenate([[SPACE], codes, [SPACE]])
    codes = codes[~((codes == SPACE) & np.concatenate([[False], codes[:-1] == SPACE]))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 1024, seed: int = 7, most: int = 10_000) -> dict[str, np.ndarray]:
    """A prototype for each language: the bundle of all trigrams of all its texts.

    Every row with a language and a text counts. A task sums the rows of a language before it sends
    them; the sums of tasks are added component by component. What reaches the driver is ``size``
    numbers a language; more than ``most`` languages are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(size, seed), {}
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, []).append(trigrams(text.as_py()))
            for lang, parts in found.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([n for _, n in parts]), len(grams))
                sums[lang] = sums.get(lang, 0) + space.bundle(grams, counts)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "profile"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(tidied(run, LEARNED_AT_ONCE), "lang string, profile array<double>").select("lang", F.posexplode("profile").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    profiles = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select("lang", F.transform("p", lambda e: e.x).alias("p"))
    found = profiles.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    return {r.lang: np.array(r.p) for r in sorted(found, key=lambda r: r.lang) if np.any(r.p)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text_col: str = "text", size: int = 1024, seed: int = 7, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row, lang_pred and score, or what ``names`` calls them: the language whose prototype has the largest cosine with the text's vector, and that cosine, 0 at least.

    Ties go to the first language by code point. Texts that are null or have no letter, and all texts if
    nothing was learned, are ``und`` with score 0. Only the text is looked at. A kept column that has one of
    the two names is an error.
    """
    if {x.lower() for x in names} & {x.lower() for x in keep}:
        raise ValueError(f"a column is already called {names[0]} or {names[1]}")
    known = sorted(profiles)
    matrix = np.array([profiles[k] / np.linalg.norm(profiles[k]) for k in known]) if known else np.zeros((0, size))
    picked = docs.select(*keep, *[] if text_col in keep else [text_col])
    at = picked.columns.index(text_col)
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(size, seed)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at):
                lang, score = "und", 0.0
                grams, counts = trigrams(text.as_py())
                if len(grams) and known:
                    v = space.bundle(grams, counts)
                    if norm := np.linalg.norm(v):
                        near = matrix @ (v / norm)
                        lang, score = known[int(near.argmax())], float(min(1.0, max(0.0, near.max())))
                langs.append(lang)
                scores.append(score)
            columns = [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    ship(docs.sparkSession)
    return picked.mapInArrow(tidied(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; null for a null doc_id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row: learned from the rows not held out, predicted for all.

    A null doc_id is neither held out nor learned from. An empty table gives no rows.
    """
    profiles = learn_profiles(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, profiles, ["doc_id", "held_out"])
