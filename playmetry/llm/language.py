"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.llm.common import GOLDEN, mix64, unused

#: Components of a vector and letters of an n-gram.
WIDTH, LETTERS = 1024, 3
#: Characters of a text that are counted at a time.
SEGMENT = 1 << 20
UNDETERMINED = "und"


class Profiler:
    """Turns texts into bundles of n-gram vectors. All vectors follow from the seed and the letters.

    A letter's vector holds random signs. An n-gram binds (multiplies) the vectors of its
    letters, each permuted once more than the one after it, so order counts. A run of other
    characters is one gap symbol, and a text begins and ends with a gap.
    """

    def __init__(self, width: int = WIDTH, letters: int = LETTERS, seed: int = 11):
        self.width, self.letters, self.seed = width, letters, seed
        one = np.random.default_rng(seed).permutation(width)
        self.orders = [np.arange(width)]
        for _ in range(letters - 1):
            self.orders.append(self.orders[-1][one])
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x10000)])

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as code points, gaps as 0, gaps in a row once."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        low = codes < 0x10000
        letter = self.is_letter[np.where(low, codes, 0)] & low
        if not low.all():
            rare = np.unique(codes[~low])
            letter |= np.isin(codes, rare[[chr(c).isalpha() for c in rare.tolist()]])
        found = np.where(letter, codes, 0).astype(np.uint64)
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams that hold a letter, as numbers, and their counts."""
        tail = np.zeros(1, np.uint64)
        kinds, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for at in range(0, len(text), SEGMENT):
            part = np.concatenate([tail, self.symbols(text[at : at + SEGMENT])])
            if at + SEGMENT >= len(text):
                part = np.append(part, np.uint64(0))
            keep = np.ones(len(part), bool)
            keep[1:] = (part[1:] != 0) | (part[:-1] != 0)
            part = part[keep]
            tail = part[max(0, len(part) - self.letters + 1) :]
            n = len(part) - self.letters + 1
            if n <= 0:
                continue
            codes = np.zeros(n, np.uint64)
            for k in range(self.letters):
                codes = (codes << np.uint64(21)) | part[k : k + n]
            kinds, where = np.unique(np.concatenate([kinds, codes]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, np.ones(n, np.int64)]), len(kinds)).astype(np.int64)
        some = kinds != 0
        return kinds[some], counts[some]

    def letter_vectors(self, letters: np.ndarray) -> np.ndarray:
        words = np.arange(self.width // 64, dtype=np.uint64)[None, :] + letters.astype(np.uint64)[:, None] * np.uint64(self.width // 64 + 1)
        bits = mix64(mix64(words + np.uint64(self.seed)) * GOLDEN)
        return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)

    def gram_vectors(self, kinds: np.ndarray) -> np.ndarray:
        out = np.ones((len(kinds), self.width), np.int8)
        for k in range(self.letters):
            letters, where = np.unique((kinds >> np.uint64(21 * (self.letters - 1 - k))) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= self.letter_vectors(letters)[:, self.orders[self.letters - 1 - k]][where]
        return out

    def bundles(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum of the n-gram vectors of every row: whole numbers."""
        out = np.zeros((len(rows), self.width))
        if not rows:
            return out
        kinds, where = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
        which = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        counts = np.concatenate([c for _, c in rows])
        number = np.float32 if counts.sum() < 1 << 24 else np.float64  # exact either way
        for at in range(0, len(kinds), 4096):
            inside = (where >= at) & (where < at + 4096)
            block = np.zeros((len(rows), min(4096, len(kinds) - at)), number)
            block[which[inside], where[inside] - at] = counts[inside]
            out += block @ self.gram_vectors(kinds[at : at + 4096]).astype(number)
        return out


@dataclass
class Profiles:
    """Prototypes of the learned languages, in order of their names."""

    names: list[str]
    vectors: np.ndarray
    profiler: Profiler


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = 512, profiler: Profiler | None = None) -> Profiles:
    """Bundle all texts of a language into its prototype.

    Every task adds up its own texts and hands on one vector per language, so what is summed
    and comes to the driver is languages * width numbers. More than `max_languages` languages
    are an error. Rows with a null language are left out; sums are of whole numbers, so the
    order of rows does not matter.
    """
    profiler = profiler or Profiler()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            grams = [profiler.grams(t) for t in batch.column(0).to_pylist()]
            for name in sorted(set(names)):
                kinds, where = np.unique(np.concatenate([g[0] for g, x in zip(grams, names) if x == name]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([g[1] for g, x in zip(grams, names) if x == name]), len(kinds))
                sums[name] = sums.get(name, 0) + profiler.bundles([(kinds, counts)])[0]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = known.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "v"))
    total = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).limit(max_languages * profiler.width + 1).collect()
    if len(total) > max_languages * profiler.width:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted({r.lang for r in total})
    vectors = np.zeros((len(names), profiler.width))
    for r in total:
        vectors[names.index(r.lang), r.at] = r.v
    return Profiles(names, vectors, profiler)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All columns of `docs` and lang_pred, score: the prototype with the largest cosine.

    Null texts, texts without a letter and a model without languages give `und` at score 0.
    Negative cosines score 0. Equal cosines go to the name that sorts first. Columns named
    lang_pred or score are replaced.
    """
    profiler = profiles.profiler
    names = np.array(profiles.names, object)
    lengths = np.linalg.norm(profiles.vectors, axis=1)
    units = profiles.vectors / np.where(lengths == 0, 1, lengths)[:, None]

    def run(texts: pd.Series) -> pd.DataFrame:
        grams = [profiler.grams(t or "") for t in texts]
        some = np.array([len(g[0]) > 0 for g in grams]) & (len(names) > 0)
        lang, score = np.full(len(grams), UNDETERMINED, object), np.zeros(len(grams))
        if some.any():
            bundle = profiler.bundles([g for g, s in zip(grams, some) if s])
            # Sums row by row, so a text scores the same in any company.
            dots = np.stack([(bundle * unit).sum(axis=1) for unit in units], axis=1)
            cosines = dots / np.maximum(np.sqrt((bundle * bundle).sum(axis=1)), 1e-300)[:, None]
            best = np.argmax(np.round(cosines, 12), axis=1)
            lang[some] = names[best]
            score[some] = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    judge = F.pandas_udf(run, "lang_pred string, score double")
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    inner = unused("judged", others)
    judged = docs.select(*others, judge(F.col(text)).alias(inner))
    return judged.select(*others, F.col(inner)["lang_pred"].alias("lang_pred"), F.col(inner)["score"].alias("score"))


def held_out(key: str = "doc_id"):
    """Rows kept from learning: crc32 of the key as text is a multiple of 5. Null keys are neither."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def learned(docs: DataFrame, key: str = "doc_id") -> Profiles:
    """Profiles from all rows that are not held out."""
    return learn_profiles(docs.where(~held_out(key)).select("text", "lang"))
