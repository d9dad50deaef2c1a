"""Language identification by spans (operator 8).

A word's script, from ranges of code points, narrows the languages it can be.
Character n-grams with word ends give each word a score by language, and a
Viterbi path over the words, with a penalty for each switch, labels spans of
mixed-language text. A document's language is the one with most letters.

The model is naive Bayes over hashed n-grams, learned from labelled rows: a
sample bounded by ``max_docs`` (a documented parameter), chosen by a hash of
the id. What a task sends is at most languages x buckets counts.

Defined results: a null text or one without a letter is ``und`` with score 0.
Rows are independent of each other, so repeated rows get the same label; rows
with a null label or no letters teach nothing. With no labelled rows at all
every text is ``und``. Scores are the share of letters in spans of the
predicted language. Very long texts are labelled whole, their words one after the
other. Columns other than the id and the text take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, small_batches, to_batch

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
BUCKETS = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: First code point of each range and its script.
RANGES = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"), (0x780, "other"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_NUMBERS = np.array([SCRIPTS.index(s) for _, s in RANGES])


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    return int(_NUMBERS[np.searchsorted(_STARTS, ord(word[0]), side="right") - 1])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 1 to 3 characters of words between spaces.

    (buckets 3 x places, which of them count, first place of each word): a
    place is a character or one of the two spaces of a word.
    """
    code = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(code))  # places up to the end of the word
    one = code + np.uint64(1)
    two = one * _MIX + np.append(code[1:], [0]).astype(np.uint64) + np.uint64(2)
    three = two * _MIX + np.append(code[2:], [0, 0]).astype(np.uint64) + np.uint64(3)
    h = np.stack([one, two, three]) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    counts = np.stack([(left > 1) & (left < np.repeat(size, size)), left > 1, left > 2])
    return (h >> np.uint64(49)).astype(np.int64), counts, start


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # bucket x language
    fits: np.ndarray  # script x language: can this language use the script?


def learn(df: DataFrame, text_col: str, lang_col: str, key: Column, max_docs: int = 50_000) -> Model:
    """From rows with a text and a label; about ``max_docs`` of them by a hash of ``key``, all if there are fewer."""
    rows = df.select(df[text_col].alias("text"), df[lang_col].alias("lang"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("h")).filter("lang IS NOT NULL")
    n = rows.select("lang").count()
    taken = rows.filter(F.col("text").isNotNull() & (F.col("h") < int((1 << 20) * min(1.0, max_docs / max(1, n)))))
    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, "lang string, bucket int, n long")

    def count(batches):
        words: dict[str, Counter] = {}
        totals: dict[str, np.ndarray] = {}

        def settle():
            for lang, c in words.items():
                t = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                if not c:
                    continue
                words_, n_ = list(c), np.fromiter(c.values(), np.int64, len(c))
                b, counts, start = grams(words_)
                times = np.repeat(n_, np.diff(np.append(start, b.shape[1])))
                t[:BUCKETS] += np.bincount(b[counts], weights=np.broadcast_to(times, b.shape)[counts], minlength=BUCKETS).astype(np.int64)
                for w, k in zip(words_, n_, strict=True):
                    t[BUCKETS + script_of(w)] += k * len(w)
                c.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                settle()
        settle()
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield to_batch({"lang": [lang] * len(at), "bucket": at.tolist(), "n": t[at].tolist()}, arrow)

    got = taken.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for j, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        counts[part["bucket"].to_numpy(), j] = part["n"].to_numpy()
    c, s = counts[:BUCKETS], counts[BUCKETS:]
    p = (c + 0.1) / (c.sum(axis=0, keepdims=True) + 0.1 * BUCKETS)
    fits = s >= 0.01 * np.maximum(1, s.sum(axis=0, keepdims=True))
    fits |= ~fits.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
    return Model(langs, np.log(p).astype(np.float32), fits)


def best_path(s: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the Viterbi path over word scores (words x languages).

    One label throughout is best if no stretch of words gains more by any
    other labels than a switch costs; this is tested first, without a loop.
    """
    top = int(np.argmax(s.sum(axis=0)))
    gain = (s.max(axis=1) - s[:, top]).cumsum()
    if gain[-1] == 0:
        return np.full(len(s), top)
    rest = np.delete(s, top, axis=1)
    if rest.shape[1]:
        run = np.concatenate(([0.0], (rest.max(axis=1) - s[:, top]).cumsum()))
        if (run - np.minimum.accumulate(run)).max() <= penalty:
            return np.full(len(s), top)
    # lists beat arrays here, as there are few languages
    rows = s.tolist()
    v, back = rows[0], []
    for row in rows[1:]:
        high = max(v)
        move, k = high - penalty, v.index(high)
        back.append([k if move > x else j for j, x in enumerate(v)])
        v = [(move if move > x else x) + y for x, y in zip(v, row, strict=True)]
    path = [v.index(max(v))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


class Labeller:
    """Labels texts; scores of words are kept, a bounded number of them."""

    def __init__(self, model: Model, penalty: float = 10.0, limit: int = 300_000):
        self.model, self.penalty, self.limit = model, penalty, limit
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)
        self.sizes = np.zeros(1024, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Scores of words that aren't known yet, all in one go."""
        at = len(self.rows)
        while at + len(words) > len(self.scores):
            self.scores, self.sizes = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        b, counts, start = grams(words)
        total = sum(np.where(m[:, None], self.model.log_p[x], np.float32(0)) for x, m in zip(b, counts, strict=True))
        # overlapping n-grams of three lengths count a third each; the best candidate has 0, languages of other scripts are far off
        s = np.add.reduceat(total, start, axis=0) / 3
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        fits = self.model.fits[_NUMBERS[np.searchsorted(_STARTS, first, side="right") - 1]]
        low, high = np.where(fits, s, np.inf).min(axis=1), np.where(fits, s, -np.inf).max(axis=1)
        self.scores[at : at + len(words)] = np.where(fits, s, low[:, None] - 20) - high[:, None]
        self.sizes[at : at + len(words)] = np.fromiter(map(len, words), np.int64, len(words))
        self.rows.update(zip(words, range(at, at + len(words)), strict=True))

    def known(self, texts: list[list[str]]) -> None:
        """Makes sure that all words have scores; of a full table the old ones go."""
        new = {w for ws in texts for w in ws if w not in self.rows}
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = {w for ws in texts for w in ws}
        new = list(new)
        for i in range(0, len(new), 50_000):
            self._learn(new[i : i + 50_000])

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) in code points; spans begin and end with a word."""
        found = list(LETTERS.finditer(text or ""))
        if not found or not self.model.langs:
            return []
        words = [m[0].lower() for m in found]
        self.known([words])
        path = self._path(words)[0]
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(found[a].start(), found[b - 1].end(), self.model.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _path(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return best_path(self.scores[at], self.penalty), self.sizes[at]

    def labels(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and share of letters of each text."""
        out: list[tuple[str, float]] = []
        group: list[list[str]] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(LETTERS.findall(t.lower()) if t and self.model.langs else [])
            size += len(group[-1])
            if size > 200_000 or i + 1 == len(texts):
                self.known(group)
                out += map(self._label, group)
                group, size = [], 0
        return out

    def _label(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return UND, 0.0
        path, sizes = self._path(words)
        letters = np.bincount(path, weights=sizes, minlength=len(self.model.langs))
        k = int(np.argmax(letters))
        return self.model.langs[k], float(letters[k] / letters.sum())


def identify(df: DataFrame, model: Model, penalty: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text. The model is broadcast: buckets x languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]

    def make():
        by = Labeller(shared.value, penalty)

        def call(cols):
            got = by.labels(cols["text"])
            return {"id": cols["id"], "lang_pred": [a for a, _ in got], "score": [b for _, b in got]}

        return call

    out = map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), make, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 modulo 3 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(df: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text", penalty: float = 10.0) -> DataFrame:
    """The rows of ``df``, all columns, but for those with no language or none that holds ``min_score`` of the letters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        by = Labeller(shared.value, penalty)
        for batch in batches:
            got = by.labels(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score in got]))

    return df.mapInArrow(run, df.schema)
