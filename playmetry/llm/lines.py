"""Quality rules: a linear-chain conditional random field labels the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from playmetry.llm.common import mix64, run_hashes, split_words, word_hashes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Labels of a line.
BOILERPLATE, CONTENT = 0, 1
#: What the field sees of a line, one 0/1 value each.
FEATURES = (
    "any line", "one or two words", "three to five words", "over thirty words", "repeats an earlier line", "comes again later",
    "a symbol for ten words or more", "half of the letters upper case", "a quarter digits", "ends a sentence",
    "starts in lower case", "half of the words end in punctuation", "words of the line repeat", "first or last line",
)


#: Kinds of a character, as bits.
SPACE, UPPER, LETTER, DIGIT, SYMBOL = 1, 2, 4, 8, 16


def character_kinds() -> np.ndarray:
    """Bits of every character up to U+FFFF; those beyond share the last entry, which has none."""
    kinds = np.zeros(0x10000, np.uint8)
    for c in range(0xFFFF):
        ch = chr(c)
        kinds[c] = UPPER * ch.isupper() | LETTER * ch.isalpha() | DIGIT * ch.isdigit()
    kinds[[ord(c) for c in " \t\n\r\x0b\x0c"]] = SPACE
    kinds[[ord(c) for c in SYMBOLS]] = SYMBOL
    return kinds


@dataclass
class Look:
    """What the rules need of a text: counts, word hashes, and its lines that hold a word."""

    hashes: np.ndarray
    word_chars: int
    symbols: int
    dup_lines: int
    line_words: np.ndarray
    features: np.ndarray


def look_at(text: str | None, kinds: np.ndarray) -> Look:
    """One pass over the whole text. Lines are cut at line feeds; those without a word drop out."""
    if not text:
        return Look(np.zeros(0, np.uint64), 0, 0, 0, np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))
    lines = text.split("\n")
    ends = np.cumsum([len(line) + 1 for line in lines])
    starts = np.concatenate([[0], ends[:-1]])
    kind = kinds[np.minimum(np.frombuffer((text + "\n").encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
    solid = (kind & SPACE) == 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    rough = closes & ((kind & (LETTER | DIGIT)) == 0)
    per_line = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    words, chars = per_line(begins), per_line(solid)
    upper, letters, digits, symbols = (per_line((kind & k) != 0) for k in (UPPER, LETTER, DIGIT, SYMBOL))
    rough_ends = per_line(rough)
    some = np.flatnonzero(words)
    hashes = word_hashes(split_words(text))
    owner = np.repeat(np.arange(len(lines)), words)
    kept = np.unique(hashes + mix64(owner.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(owner[kept], minlength=len(lines))
    seen: dict[str, int] = {}
    out = np.zeros((len(some), len(FEATURES)))
    dups = 0
    for at, i in enumerate(some.tolist()):
        line = lines[i]
        earlier = seen.get(line)
        if earlier is not None:
            dups += 1
            out[at, 4] = out[earlier, 5] = 1
        seen[line] = at
        bare = line.strip()
        out[at, 9] = bare[-1:] in (".", "!", "?", "…")
        out[at, 10] = bare[:1].islower()
    n = words[some]
    out[:, 0] = 1
    out[:, 1], out[:, 2], out[:, 3] = n <= 2, (n >= 3) & (n <= 5), n > 30
    out[:, 6] = 10 * symbols[some] >= n
    out[:, 7] = 2 * upper[some] >= np.maximum(letters[some], 1)
    out[:, 8] = 4 * digits[some] >= np.maximum(chars[some], 1)
    out[:, 11] = 2 * rough_ends[some] >= n
    out[:, 12] = (n >= 8) & (2 * distinct[some] <= n)
    out[[0, -1] if len(some) else [], 13] = 1
    return Look(hashes, int(solid.sum()), int(((kind & SYMBOL) != 0).sum()), dups, n, out)


@dataclass
class Field:
    """Weights of a two-label field: per feature and label, and per step from label to label."""

    emission: np.ndarray
    transition: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of a run of lines; equal paths prefer content."""
        scores = (features @ self.emission).tolist()
        (bb, bc), (cb, cc) = self.transition.tolist()
        back, b, c = [], 0.0, 0.0
        for k, (eb, ec) in enumerate(scores):
            if k:
                from_b, to_b = (b + bb > c + cb), max(b + bb, c + cb)
                from_c, to_c = (b + bc > c + cc), max(b + bc, c + cc)
                back.append((from_b, from_c))
                b, c = to_b, to_c
            b, c = b + eb, c + ec
        labels = np.full(len(scores), CONTENT, np.int64)
        now = BOILERPLATE if b > c else CONTENT
        for k in range(len(scores) - 1, -1, -1):
            labels[k] = now
            if k:
                stays_b = back[k - 1][now]
                now = BOILERPLATE if stays_b else CONTENT
        return labels


#: Lines of a training chain; longer texts are several chains, and every line is in one.
CHAIN = 256


def _chains(texts: list[np.ndarray], labels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, present) of all lines, chains of like length padded to one length."""
    cut = [(f[a : a + CHAIN], l[a : a + CHAIN]) for f, l in zip(texts, labels) for a in range(0, len(f), CHAIN)]
    out = []
    for low, high in ((0, 8), (8, 32), (32, CHAIN)):
        mine = [(f, l) for f, l in cut if low < len(f) <= high]
        if mine:
            shape = (len(mine), max(len(f) for f, _ in mine))
            x, y, there = np.zeros((*shape, texts[0].shape[1])), np.zeros(shape, np.int64), np.zeros(shape, bool)
            for i, (f, l) in enumerate(mine):
                x[i, : len(f)], y[i, : len(f)], there[i, : len(f)] = f, l, True
            out.append((x, y, there))
    return out


def likelihood(field: Field, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of labelled chains and its gradient by emission and transition (forward-backward)."""
    truth = np.eye(2)[y] * there[:, :, None]
    e = x @ field.emission
    a, z = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for t in range(1, x.shape[1]):
        step = np.logaddexp.reduce(a[:, t - 1, :, None] + field.transition[None], axis=1) + e[:, t]
        a[:, t] = np.where(there[:, t, None], step, a[:, t - 1])
    for t in range(x.shape[1] - 2, -1, -1):
        step = np.logaddexp.reduce(field.transition[None] + (e[:, t + 1] + z[:, t + 1])[:, None, :], axis=2)
        z[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    whole = np.logaddexp.reduce(a[:, -1], axis=1)
    chance = np.exp(a + z - whole[:, None, None]) * there[:, :, None]
    pair = np.exp(a[:, :-1, :, None] + field.transition + (e + z)[:, 1:, None, :] - whole[:, None, None, None]) * there[:, 1:, None, None]
    seen_t = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    value = float((e * truth).sum() + (seen_t * field.transition).sum() - whole.sum())
    return value, np.einsum("ntk,ntl->kl", x, truth - chance), seen_t - pair.sum((0, 1))


def fit_field(texts: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3, start: Field | None = None, steps: bool = True) -> Field:
    """Maximum likelihood by gradient ascent from `start`; without `steps` the transitions stay as they are."""
    k = len(FEATURES)
    field = start or Field(np.zeros((k, 2)), np.zeros((2, 2)))
    groups = _chains(texts, labels) if texts else []
    total = sum(int(there.sum()) for _, _, there in groups)
    speed_e, speed_t = np.zeros_like(field.emission), np.zeros_like(field.transition)
    for _ in range(rounds if total else 0):
        grads = [likelihood(field, *g)[1:] for g in groups]
        grad_e = sum(g for g, _ in grads) / total - decay * field.emission
        grad_t = sum(g for _, g in grads) / total - decay * field.transition
        speed_e, speed_t = 0.9 * speed_e + rate * grad_e, 0.9 * speed_t + rate * grad_t * steps
        field = Field(field.emission + speed_e, field.transition + speed_t)
    return field


def constrained_labels(field: Field, features: np.ndarray, words: np.ndarray, kind: int) -> np.ndarray:
    """The likeliest labels of a text's lines of which at least half the words lie in lines of `kind`.

    If the likeliest labels break that, all lines lean towards `kind` by the least amount that mends it.
    """
    half = words.sum() / 2

    def lean(much: float) -> np.ndarray:
        tilted = Field(np.vstack([field.emission, much * np.eye(2)[kind]]), field.transition)
        return tilted.viterbi(np.hstack([features, np.ones((len(features), 1))]))

    enough = lambda labels: words[labels == kind].sum() >= half
    labels = lean(0.0)
    if enough(labels):
        return labels
    low, high = 0.0, 1.0
    while not enough(lean(high)):
        low, high = high, 2 * high
    for _ in range(12):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(lean(middle)) else (middle, high)
    return lean(high)


def field_of_texts(texts: list[np.ndarray], words: list[np.ndarray], good: list[int], turns: int = 4) -> Field:
    """A field learned from labels of whole texts, as bounds on their lines and not as copies.

    A text labelled 1 has at least half its words in content lines, one labelled 0 at least
    half in boilerplate. Lines are told apart one by one first (no steps between labels); then
    the likeliest line labels within the bounds and the fit take turns, so a clean line of a
    junk text may become content, and steps from label to label are learned from such texts.
    """
    kinds = [CONTENT if g else BOILERPLATE for g in good]
    field = fit_field(texts, [np.full(len(f), k) for f, k in zip(texts, kinds)], rounds=80, steps=False)
    for _ in range(turns):
        labels = [constrained_labels(field, f, w, k) for f, w, k in zip(texts, words, kinds)]
        field = fit_field(texts, labels, rounds=40, start=field)
    return field


def learn_lines(docs: DataFrame, labels: DataFrame, sample: int = 3000, key: str = "doc_id", text: str = "text", good: str = "quality") -> Field:
    """The field, fitted on a bounded sample of labelled texts.

    `sample` keys of `labels` with the least hash are taken (of repeated ones the least label)
    and all lines of one text each, the one of least hash where a key repeats; so the features
    of `sample` texts reach the driver, one byte each. With no labels all lines are content.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(good).isNotNull())
        .groupBy(F.col(key).alias("__key")).agg(F.min(good).cast("int").alias("__good"))
        .orderBy(F.xxhash64("__key"), "__key").limit(sample)
    )
    texts = docs.join(F.broadcast(chosen), F.col(key) == F.col("__key")).where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col("__key").cast("long").alias("k"), F.col("__good").alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_kinds()
        for batch in batches:
            rows = []
            for t, k, g in zip(*[c.to_pylist() for c in batch.columns]):
                seen = look_at(t, kinds)
                rows.append((k, g, xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1, seen.line_words.astype(np.int64).tobytes(), seen.features.astype(np.uint8).tobytes()))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["k", "good", "h", "words", "features"])

    one = texts.mapInArrow(run, "k long, good int, h long, words binary, features binary").groupBy("k").agg(F.min(F.struct("h", "good", "words", "features")).alias("t"))
    rows = sorted((r.k, r.t.good, bytes(r.t.words), bytes(r.t.features)) for r in one.collect() if r.t.words)  # at most `sample` rows
    found = [np.frombuffer(f, np.uint8).reshape(-1, len(FEATURES)).astype(float) for *_, f in rows]
    return field_of_texts(found, [np.frombuffer(w, np.int64) for _, _, w, _ in rows], [g for _, g, _, _ in rows])


def repeated_words(hashes: np.ndarray, window: int = 8) -> int:
    """Words under windows of `window` words that the text holds twice or more, the first included."""
    runs = run_hashes(hashes, window)
    if len(runs) < 2:
        return 0
    _, where, times = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[where] > 1)
    marks = np.zeros(len(hashes) + 1, np.int64)
    marks[starts] += 1
    marks[starts + window] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def judge(text: str | None, kinds: np.ndarray, field: Field, share: float) -> tuple:
    seen = look_at(text, kinds)
    n = len(seen.hashes)
    again = repeated_words(seen.hashes)
    failed = n < 20 or 100 * again > 30 * n
    content = float(seen.line_words[field.viterbi(seen.features) == CONTENT].sum() / n) if n else 0.0
    return n, seen.word_chars, seen.symbols, seen.dup_lines, again, failed, content, (not failed) and content >= share


def quality_rules(docs: DataFrame, field: Field, share: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    Viterbi decoding labels every line that holds a word; `content_share` is the share of
    words in content lines (0 without words), and a text that passes the base rules is kept
    from `share` on. Null and empty texts have no words, fail the base rules and are not
    kept. Each row is judged by itself, so repeated rows get equal results.
    """
    columns = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_kinds()
        for batch in batches:
            cols = list(zip(*[judge(t, kinds, field, share) for t in batch.column(1).to_pylist()])) or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, columns))], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)
