"""Language identification with spans for mixed-language text.

A word ends at a blank, or where the script of its letters changes. Per word: the script of its letters (by code-point ranges) leaves only the languages that use this script; each of them
scores the word by hashed character n-grams. Per text: Viterbi over the words, where changing the language costs `penalty`,
labels spans; the language of most letters is the prediction.

What is learned are n-gram counts per language from a bounded sample of labelled rows, `rows_per_language` for each language
about, chosen by a hash of their id, and which scripts a language uses. The table of counts has a fixed number of slots, and
columns for the `most_languages` languages with most rows; how many languages and rows are beyond that is said in a warning.
Texts are labelled as a whole, texts of a slice in step, one word after the other; how many in step, and in what stretches a long one, goes by words
times languages, so that a worker's memory does not grow with either.

Defined cases: null text, or text without a letter, is `und` with score 0; so is everything if nothing was learned; rows
whose language is null teach nothing; long words and texts are read as a whole; repeated rows each get their row; other
columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import U64, mixed, parts, prepare

#: First code points of script ranges and the script from there on (0: no script of its own).
SCRIPT_STARTS = [0x0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x750, 0x780, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xFB50, 0xFE00, 0x20000]
SCRIPT_NAMES = ["", "latin", "", "greek", "cyrillic", "armenian", "hebrew", "arabic", "", "arabic", "", "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar", "georgian", "hangul", "ethiopic", "latin", "greek", "", "kana", "kana", "", "han", "", "hangul", "", "arabic", "", "han"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
_starts = np.array(SCRIPT_STARTS)
_scripts = np.array([SCRIPTS.index(x) for x in SCRIPT_NAMES])
GRAMS = (1, 2, 3)
UNKNOWN = "und"
NEVER = np.float32(-1e4)
CELLS = 1 << 22
_blank = re.compile(r"\s")
_beyond_latin = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u3040-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Words of a text: runs without blanks, cut before a letter of another script than the letter before it."""
    if not _beyond_latin.search(text):
        return text.split()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    script = _scripts[np.searchsorted(_starts, points, side="right") - 1]
    script[((points > 0x5A) & (points < 0x61)) | ((points > 0x7A) & (points < 0xC0))] = 0  # signs among Latin letters
    at = np.flatnonzero(script)
    cuts = at[1:][script[at[1:]] != script[at[:-1]]].tolist()
    return " ".join(text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)).split()


def letters_of(word: str) -> str:
    """The word's letters and marks in lower case."""
    if word.isalpha():
        return word.lower()
    return "".join(c for c in word.lower() if c.isalpha() or (c > "̀" and not c.isprintable()) or "̀" <= c <= "ͯ")


@dataclass
class Grams:
    """Slots of the n-grams of many words, the word that each belongs to, and the script of each word."""

    slots: np.ndarray
    words: np.ndarray
    scripts: np.ndarray


def grams(words: list[str], slots: int) -> Grams:
    """n-grams of non-empty words, with the blanks around them."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(U64)
    blank = points == 32
    word = np.cumsum(blank) - 1  # a blank counts as the one before the next word
    first = np.flatnonzero(blank)[:-1] + 1
    scripts = _scripts[np.searchsorted(_starts, points[first].astype(np.int64), side="right") - 1]
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            count = len(points) - n + 1
            if count <= 0:
                continue
            total, inner = np.full(count, n, U64), np.zeros(count, bool)
            for k in range(n):
                total = total * U64(0x9E3779B97F4A7C15) + points[k : k + count]
                if 0 < k < n - 1:
                    inner |= blank[k : k + count]
            at = np.flatnonzero(~inner if n > 1 else ~inner & ~blank)
            found.append((mixed(total[at]) % U64(slots)).astype(np.int64))
            owner.append(word[at])
    return Grams(np.concatenate(found), np.concatenate(owner), scripts)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # slots x languages
    scripts: np.ndarray  # scripts x languages: whether the language uses the script

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words by language, the best one 0; all 0 for a script that no language uses."""
        g = grams(words, len(self.logs))
        order = np.argsort(g.words, kind="stable")
        owner = g.words[order]
        first = np.searchsorted(owner, np.arange(len(words)))
        total = np.add.reduceat(self.logs[g.slots[order]], first, axis=0)
        allowed = self.scripts[g.scripts]
        known = allowed.any(1)
        total = np.where(allowed, total, NEVER)
        total -= total.max(1, keepdims=True)
        total[~known] = 0
        return total.astype(np.float32)


class Labeller:
    """Labels texts; keeps the scores of up to `limit` words, and fewer if there are many languages. cells: words times languages in memory at once."""

    def __init__(self, languages: Languages, penalty: float, most: float, limit: int = 150_000, cells: int = CELLS) -> None:
        self.l, self.penalty, self.most, self.cells = languages, np.float32(penalty), np.float32(most), cells
        self.limit = min(limit, 4 * cells // max(1, len(languages.names)))
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((0, len(self.l.names)), np.float32)
        self.sizes = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        plain = [letters_of(w) for w in words]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        scores = np.zeros((len(words), len(self.l.names)), np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            raw = self.l.word_scores([plain[k] for k in full])
            scores[full] = np.where(raw <= NEVER / 2, NEVER, np.maximum(raw, -self.most))  # one odd word must not decide
        for w in words:
            self.number[w] = len(self.number)
        self.scores, self.sizes = np.concatenate([self.scores, scores]), np.concatenate([self.sizes, sizes])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, and how many each text has."""
        split = [words_of(t) for t in texts]
        if len(self.number) > self.limit:
            self._clear()
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.number]
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((i for ws in split for i in map(self.number.__getitem__, ws)), np.int64, int(counts.sum())), counts

    def label(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The Viterbi language of each word, all texts in step."""
        labels = np.zeros(len(at), np.int16)
        begins = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        begins, counts = begins[order], counts[order]
        steps = int(counts[0]) if len(counts) else 0
        own = np.arange(self.scores.shape[1], dtype=np.int16)
        back = np.zeros((len(at), len(own)), np.int16)
        alive = np.searchsorted(-counts, -np.arange(steps), side="left")  # texts with more words than step
        best = np.zeros((len(begins), len(own)), np.float32)
        for step in range(steps):
            n = alive[step]
            place = begins[:n] + step
            if step:
                b = best[:n]
                top = b.argmax(1)
                change = b[np.arange(n), top] - self.penalty
                from_ = b < change[:, None]
                back[place] = np.where(from_, top[:, None], own)
                best[:n] = np.maximum(b, change[:, None])
            best[:n] += self.scores[at[place]]
        current = best.argmax(1)
        for step in range(steps - 1, -1, -1):
            n = alive[step]
            place = begins[:n] + step
            labels[place] = current[:n]
            if step:
                current[:n] = back[place, current[:n]]
        return labels

    def texts(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words) of each text; as many texts in step as fit into CELLS words times languages, longer ones in stretches."""
        if not self.l.names:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        out, some, held = [], [], 0
        for t in texts:
            own = (len(t) // 2 + 1) * len(self.l.names)  # words there can be
            if some and held + own > self.cells:
                out += self._together(some)
                some, held = [], 0
            if own > self.cells:
                out.append(self._long(t))
            else:
                some.append(t)
                held += own
        return out + self._together(some)

    def _along(self, best: np.ndarray | None, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over some words of one text, from the scores before them: the scores after, whether a language is come to from another one, and which."""
        changed, tops = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
        for k, s in enumerate(scores):
            if best is None:
                best = s.copy()
                continue
            tops[k] = best.argmax()
            change = best[tops[k]] - self.penalty
            np.less(best, change, out=changed[k])
            best = np.maximum(best, change) + s
        return best, changed, tops

    def _long(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        """A text of any length: forward by stretches, of which only the scores at their beginnings are kept, and back through each once more."""
        n = len(self.l.names)
        cuts = [0]
        while cuts[-1] < len(text):
            blank = _blank.search(text, cuts[-1] + max(1, 2 * self.cells // n))
            cuts.append(blank.start() if blank else len(text))
        stretches = list(zip(cuts, cuts[1:], strict=False))
        best, begins = None, []
        for a, b in stretches:
            begins.append(best)
            at, _ = self.words([text[a:b]])
            if len(at):
                best = self._along(best, self.scores[at])[0]
        if best is None:
            return UNKNOWN, 0.0, []
        current, labels = int(best.argmax()), []
        sizes, against = np.zeros(n, np.int64), np.zeros((n, n))
        for (a, b), begin in zip(reversed(stretches), reversed(begins), strict=True):
            at, _ = self.words([text[a:b]])
            if not len(at):
                continue
            scores = self.scores[at]
            _, changed, tops = self._along(begin, scores)
            y = np.zeros(len(at), np.int16)
            for k in range(len(at) - 1, -1, -1):
                y[k] = current
                if changed[k, current]:
                    current = int(tops[k])
            labels.append(y)
            sizes += np.bincount(y, weights=self.sizes[at], minlength=n).astype(np.int64)
            np.add.at(against, y, np.maximum(scores, -self.most))
        winner = int(sizes.argmax())
        return self._verdict(np.concatenate(labels[::-1]), sizes, against[winner])

    def _verdict(self, y: np.ndarray, by: np.ndarray, mean: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        """From the labels, the letters of each language, and the sums of the winner's words."""
        if not by.sum():
            return UNKNOWN, 0.0, []
        winner = int(by.argmax())
        sure = 1 / np.exp(mean - mean[winner]).sum()
        edges = np.flatnonzero(np.r_[True, y[1:] != y[:-1], True])
        spans = [(int(a), int(b), self.l.names[y[a]]) for a, b in zip(edges, edges[1:], strict=False)]
        return self.l.names[winner], float(np.clip(by[winner] / by.sum() * sure, 0, 1)), spans

    def _together(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        at, counts = self.words(texts)
        labels, sizes, scores = self.label(at, counts), self.sizes[at], self.scores[at]
        out, begin = [], 0
        for n in counts.tolist():
            y, size, s = labels[begin : begin + n], sizes[begin : begin + n], scores[begin : begin + n]
            begin += n
            by = np.bincount(y, weights=size, minlength=len(self.l.names))
            out.append(self._verdict(y, by, np.maximum(s[y == by.argmax()], -self.most).sum(0, dtype=np.float64)))
        return out


def learn_languages(labelled: DataFrame, slots: int = 1 << 15, rows_per_language: int = 3000, smoothing: float = 0.5, most_languages: int = 400) -> Languages:
    """From columns doc_id, text and lang. The driver gets one array of `slots` counts per language, of `most_languages` at most."""
    spark = labelled.sparkSession
    prepare(spark)
    given = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = given.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in known.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if len(counts) == most_languages and (more := known.agg(F.count(F.lit(1)), F.sum("n")).first())[0] > most_languages:
        warnings.warn(f"{more[0] - most_languages} languages with {more[1] - sum(counts.values())} rows in all are beyond most_languages and are not learned", stacklevel=2)
    if not counts:
        return Languages([], np.zeros((slots, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, rows_per_language / n) * (1 << 30)))])
    sample = given.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in (x for whole in batches for x in parts(whole, 4 << 20)):
            by: dict[str, Counter] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in by.items():
                plain = [(letters_of(w), n) for w, n in words.items()]
                plain = [(w, n) for w, n in plain if w]
                if not plain:
                    continue
                g, times = grams([w for w, _ in plain], slots), np.array([n for _, n in plain])
                got = [np.bincount(g.slots, times[g.words], minlength=slots), np.bincount(g.scripts, times, minlength=len(SCRIPTS))]
                totals[lang] = [a + b for a, b in zip(totals[lang], got, strict=True)] if lang in totals else got
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "grams": [x[0].tobytes() for x in totals.values()], "scripts": [x[1].tobytes() for x in totals.values()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = [np.frombuffer(x, np.float64) for x in both]
                totals[lang] = [a + b for a, b in zip(totals[lang], got, strict=True)] if lang in totals else got
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "grams": [x[0].tobytes() for x in totals.values()], "scripts": [x[1].tobytes() for x in totals.values()]})

    schema = "lang string, grams binary, scripts binary"
    rows = sorted(sample.mapInArrow(count, schema).repartition(max(2, len(counts)), "lang").mapInArrow(add, schema).collect())
    if not rows:
        return Languages([], np.zeros((slots, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    table = np.stack([np.frombuffer(r.grams, np.float64) for r in rows], axis=1)
    scripts = np.stack([np.frombuffer(r.scripts, np.float64) for r in rows], axis=1)
    logs = np.log((table + smoothing) / (table.sum(0) + smoothing * slots))
    return Languages([r.lang for r in rows], logs.astype(np.float32), scripts >= 0.01 * scripts.sum(0))


def label_languages(docs: DataFrame, languages: Languages, penalty: float = 5.0, most: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, end, language) of each row's whole text.

    penalty: what a change of language costs. most: how much one word can speak against a language, at the most.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(languages)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty, most)
        for batch in (x for whole in batches for x in parts(whole, 4 << 20)):
            found = labeller.texts([x or "" for x in batch.column(1).to_pylist()])
            spans = [[{"first": a, "end": b, "lang": k} for a, b, k in x] for _, _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")


def held_out_language_id(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 4 is not 2 and predict all: doc_id, held_out, lang_pred, score, spans."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    languages = learn_languages(docs.where(~held))
    return label_languages(docs, languages).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.to_json("spans").alias("spans"))
