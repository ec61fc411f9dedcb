"""Language of whole texts, and of the spans of mixed-language texts.

Script ranges narrow the languages that a word can be in; each word gets a score in each of them, from
the language's letter trigrams and its words; Viterbi over a text's words, with a penalty for each
change of language, labels the spans. The language of the text is that of most letters.

The model is learned from a bounded sample of rows with a label: about SAMPLE of each language, picked
by a hash of the id, all of them where there are fewer, equal texts of a language once. Whole texts are learned from and
labelled. Their words are counted where they are; the driver gets at most WORDS_KEPT words with counts of each language (the most frequent),
never a text. Every label is learned; more than LABELS of them are no languages and an error.

Defined results: `und` with score 0 if text is null or has no letter; a text in a script of no learned
language gets a learned value with score 0; ties go to the language first in order; repeated rows get equal results;
with nothing to learn from every text is `und`; an empty table gives an empty table. The score is the
share of the text's letters that are in spans of the language and in one of its scripts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortloom.llm.common import alone, table

#: Rows of each language to learn from, about; words of each that are kept; languages at most.
SAMPLE, WORDS_KEPT, LABELS = 400, 20_000, 1000
#: What a change of language costs, in natural-log units; weight of whole-word counts against trigrams.
SWITCH, WORD_WEIGHT = 8.0, 0.3
#: Share of a language's letters that a script must have to be one of its scripts.
SCRIPT_SHARE = 0.02
#: Words remembered by a worker; bytes of text labelled together.
REMEMBERED, TOGETHER = 200_000, 6 << 20
#: First and last code point of the letters of each script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Syriac": [(0x700, 0x74F)],
    "Thaana": [(0x780, 0x7BF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
WORD = re.compile(r"[^\W\d_]+")
BOUNDS = np.array(sorted((a, b, k + 1) for k, r in enumerate(SCRIPTS.values()) for a, b in r))


def script_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, 0 if of none."""
    at = np.searchsorted(BOUNDS[:, 0], points, "right") - 1
    return np.where((at >= 0) & (points <= BOUNDS[at, 1]), BOUNDS[at, 2], 0)


def has_letter(words: list[str]) -> bool:
    """Whether any is a letter: \\w also holds numerals such as superscripts."""
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each letter trigram, with one boundary on either side, and the word's number)."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length + 2) - length - 2
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + first[of]
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], of


@dataclass
class Model:
    """What is learned: scores of trigrams and words in each language, and the languages of each script."""

    languages: list[str]
    codes: np.ndarray
    scores: np.ndarray  # one row more than codes, for all others
    words: dict[str, np.ndarray]
    fits: np.ndarray  # script, language
    table: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def learn(cls, texts: Iterator[tuple[str, str]]) -> Model:
        counts: dict[str, Counter] = {}
        for language, text in texts:
            counts.setdefault(language, Counter()).update(WORD.findall(text.lower()))
        return cls.of_counts(counts)

    @classmethod
    def of_counts(cls, counts: dict[str, Counter]) -> Model:
        """From the words of each language, in lower case, and how often each was there."""
        languages = sorted(counts)
        grams, fits = [], np.zeros((len(SCRIPTS) + 1, len(languages)), bool)
        for k, language in enumerate(languages):
            words = list(counts[language])
            if not words:
                grams.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            n = np.fromiter(counts[language].values(), np.int64, len(words))
            code, of = trigrams(words)
            unique, inverse = np.unique(code, return_inverse=True)
            grams.append((unique, np.bincount(inverse, n[of])))
            letters = np.bincount(script_of((code >> 21) & 0x1FFFFF), n[of], len(SCRIPTS) + 1)
            fits[:, k] = letters >= SCRIPT_SHARE * letters.sum()
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in grams)]))
        scores = np.zeros((len(codes) + 1, len(languages)))
        for k, (code, n) in enumerate(grams):
            scores[np.searchsorted(codes, code), k] = n
            scores[:, k] = np.log((scores[:, k] + 0.5) / (n.sum() + 0.5 * (len(codes) + 1)))
        common = Counter()
        for c in counts.values():
            common.update({w: n for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5000] if n > 2})
        total = np.array([max(1, sum(counts[x].values())) for x in languages])
        words = {w: np.log((np.array([counts[x][w] for x in languages]) + 0.5) / (total + 0.5)) for w in common}
        return cls(languages, codes, scores.astype(np.float32), words, fits)

    def _learn_words(self, new: list[str]) -> None:
        """Scores of words that aren't in the table yet."""
        if len(self.table) > REMEMBERED:
            self.table.clear(), self.rows.clear()
        code, of = trigrams(new)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != code] = len(self.codes)
        out = np.empty((len(new), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(of, self.scores[at, k], len(new))
        for i, w in enumerate(new):
            if w in self.words:
                out[i] += WORD_WEIGHT * self.words[w]
        # A word's script is that of most of its letters, the first in order of several.
        each, kinds, script = script_of((code >> 21) & 0x1FFFFF), len(SCRIPTS) + 1, np.zeros(len(new), np.int64)
        for i in range(0, len(new), 4096):
            s, e = np.searchsorted(of, (i, i + 4096))
            n = min(4096, len(new) - i)
            script[i : i + n] = np.bincount((of[s:e] - i) * kinds + each[s:e], minlength=n * kinds).reshape(n, kinds).argmax(1)
        ok = self.fits[script]
        out[~ok & ok.any(1)[:, None]] = -1e6
        out[~ok.any(1)] = 0
        out -= out.max(1, keepdims=True)
        known = np.concatenate([out.clip(min=-1e4), ok.any(1)[:, None].astype(np.float32)], axis=1)
        start = sum(map(len, self.rows))
        self.rows.append(known)
        self.table.update(zip(new, range(start, start + len(new)), strict=True))

    def forget(self) -> None:
        self.table.clear(), self.rows.clear()

    def score_words(self, found: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(scores, one row per known word, the last column whether a language has its script; row numbers of each text's words)."""
        known = self.table
        new = {w for words in found for w in words if w not in known}
        if new:
            if len(known) + len(new) > REMEMBERED and known:
                known.clear(), self.rows.clear()
                new = {w for words in found for w in words}
            self._learn_words(sorted(new))
            self.rows[:] = [np.concatenate(self.rows)]
        scores = self.rows[0] if self.rows else np.zeros((0, len(self.languages) + 1), np.float32)
        return scores, [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in found]

    def label(self, found: list[list[str]], switch: float = SWITCH) -> tuple[list[np.ndarray], np.ndarray]:
        """(language number of each word of each text; scores' script column by word, joined). Viterbi, all texts side by side."""
        scores, numbers = self.score_words(found)
        order = sorted(range(len(found)), key=lambda i: -len(found[i]))
        length = np.array([len(found[i]) for i in order] or [0], np.int64)
        base = np.cumsum(length) - length
        flat = np.concatenate([np.zeros(0, np.int64), *(numbers[i] for i in order)])
        n, langs = len(flat), len(self.languages)
        moved, source = np.zeros((n, langs), bool), np.zeros(n, np.int16)
        state = np.zeros(len(order), np.int64)
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), "left") if steps else []  # texts longer than t
        best: np.ndarray = np.zeros((0, langs), np.float32)
        for t in range(steps):
            k = live[t]
            at = base[:k] + t
            s = scores[flat[at], :langs]
            if t:
                if k < len(best):
                    state[k : len(best)] = best[k:].argmax(1)
                    best = best[:k]
                top = best.argmax(1)
                lead = best[np.arange(k), top] - np.float32(switch)
                moved[at] = best < lead[:, None]
                source[at] = top
                s = s + np.maximum(best, lead[:, None])
            best = s
        state[: len(best)] = best.argmax(1)
        labels = np.empty(n, np.int16)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            at = base[:k] + t
            now = state[:k]
            labels[at] = now
            if t:
                change = moved[at, now]
                now[change] = source[at][change]
        out: list[np.ndarray] = [None] * len(found)  # type: ignore[list-item]
        fit: list[np.ndarray] = [None] * len(found)  # type: ignore[list-item]
        seen = scores[flat, langs] > 0 if n else np.zeros(0, bool)
        for rank, i in enumerate(order):
            out[i] = labels[base[rank] : base[rank] + length[rank]]
            fit[i] = seen[base[rank] : base[rank] + length[rank]]
        return out, fit

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans as (start, end, language) in code points) of each text."""
        return [(*p, spans_of(t, l, self.languages)) for t, p, l in zip(texts, *self.decide(texts), strict=True)]

    def decide(self, texts: list[str]) -> tuple[list[tuple[str, float]], list[np.ndarray]]:
        found = [WORD.findall(lowered(t)) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts), [np.zeros(0, np.int16)] * len(texts)
        labels, fits = self.label(found)
        out = []
        for words, label, fit in zip(found, labels, fits, strict=True):
            if not words or not has_letter(words):
                out.append(("und", 0.0))
                continue
            letters = np.fromiter(map(len, words), np.int64, len(words))
            by = np.bincount(label, letters, len(self.languages))
            k = int(by.argmax())
            out.append((self.languages[k], float(letters[fit & (label == k)].sum() / letters.sum())))
        return out, labels


def lowered(text: str) -> str:
    """In lower case, each character where it was (one that would become two stays)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def spans_of(text: str, labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    for m, k in zip(WORD.finditer(lowered(text)), labels.tolist(), strict=False):
        if spans and spans[-1][2] == languages[k]:
            spans[-1] = (spans[-1][0], m.end(), languages[k])
        else:
            spans.append((m.start(), m.end(), languages[k]))
    return spans


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows (doc_id, text, lang): about `sample` of each language, whatever the size of the table."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)).alias("draw"), "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("draw").alias("least")).limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"lang has more than {LABELS} values")
    if not counts:
        return Model.of_counts({})
    # Draws below a language's share of rows, and in any case the least one there is.
    below = F.from_json(F.lit(json.dumps({r["lang"]: max(int(min(1.0, sample / r["count"]) * (1 << 30)), r["least"] + 1) for r in counts})), "map<string, bigint>")
    picked = rows.where(F.col("draw") < F.element_at(below, F.col("lang"))).select("lang", "text").dropDuplicates()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                found: Counter = Counter()
                for language, text in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    found.update((language, w) for w in WORD.findall(text.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = picked.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    seen: dict[str, Counter] = {r["lang"]: Counter() for r in counts}
    for r in words.withColumn("place", place).where(f"place <= {WORDS_KEPT}").select("lang", "word", "n").toLocalIterator():
        seen[r["lang"]][r["word"]] = r["n"]
    return Model.of_counts(seen)


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and, if asked for, spans) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<start int, end int, lang string>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        alone("languages", known.forget)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start, size = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > TOGETHER:
                    some = texts[start:i]
                    got, labels = known.decide(some)
                    columns = [batch.column(0).slice(start, i - start), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                    if with_spans:
                        spans = [[{"start": s, "end": e, "lang": x} for s, e, x in spans_of(a, b, known.languages)] for a, b in zip(some, labels, strict=True)]
                        columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])
                    start, size = i, 0
                size += len(t or "")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def spoken(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has letters and a language with a score of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        alone("languages", known.forget)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                got, _ = known.decide([t or "" for t in batch.column(place).to_pylist()])
                yield batch.filter(pa.array([language != "und" and score >= least for language, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned_outside(docs: DataFrame) -> Model:
    """Learned from the rows whose crc32(doc_id as text) mod 4 is not 2."""
    return learn(docs.where(~held_out(F.col("doc_id"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned_outside(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
