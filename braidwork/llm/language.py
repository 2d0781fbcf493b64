"""Language ID of mixed texts by Viterbi over words.

Character n-grams counted per language give every word a score in each
language; the script of the word narrows the candidates first. Viterbi with a
penalty for switching then labels the words of a text, and runs of one label
are its spans. A word is a run of letters (Unicode category L, with the marks
that follow them) of one script; runs of more than ``PIECE`` letters, as in
scripts without spaces, are cut into consecutive words, so that all letters
are read. All texts of a batch go through Viterbi in step.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, sampled, table, without
from .quality import remainder

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PIECE = 64
#: What str.split takes as words, with their places.
TOKEN = regex.compile(r"[^\s\x1c-\x1f]+")
#: First code points of ranges and their scripts.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x20000, "Han"),
)
_STARTS = [s for s, _ in SCRIPTS]
FLOOR = -8.0
BARRED = -16.0
#: Scores of words are counted in such parts of a natural logarithm.
UNIT = 1 << 16


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def pieces(token: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words in ``token``: small letters, marked with < and > where a run of letters begins and ends."""
    out = []
    for run in WORD.finditer(token):
        raw, cuts = run[0], [0]
        if not raw.isascii():
            kinds = []
            for c in raw:  # a mark belongs to the letter before it
                kinds.append(kinds[-1] if kinds and category(c)[0] == "M" else script(c))
            cuts += [i for i in range(1, len(raw)) if kinds[i] != kinds[i - 1]]
        cuts.append(len(raw))
        if len(raw) > PIECE:
            cuts = [i for a, b in zip(cuts, cuts[1:]) for i in range(a, b, PIECE)] + [len(raw)]
        for a, b in zip(cuts, cuts[1:]):
            word = f"{'<' if a == 0 else ''}{raw[a:b].lower()}{'>' if b == len(raw) else ''}"
            out.append((run.start() + a, run.start() + b, word))
    return out


def grams(word: str) -> list[str]:
    """Letters, pairs and triples of a word and its marks."""
    return [*(c for c in word if c not in "<>"), *map("".join, zip(word, word[1:])), *map("".join, zip(word, word[1:], word[2:]))]


def _keys(marked: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For letters, pairs and triples of marked words, one after the other in code points: keys (21 bits for each) and the words they belong to."""
    wide = marked.astype(np.int64)
    letter = (marked != ord("<")) & (marked != ord(">"))
    out = [(wide[letter], owner[letter])]
    two = wide[:-1] | wide[1:] << 21
    inside = owner[:-1] == owner[1:]
    out.append((two[inside], owner[:-1][inside]))
    three = two[:-1] | wide[2:] << 42
    inside = owner[:-2] == owner[2:]
    out.append((three[inside], owner[:-2][inside]))
    return out


class Model:
    """Languages in order, log probabilities by n-gram, and the languages of each script: those that have ``least_share`` of their learned letters in it."""

    def __init__(self, rows: list[tuple[str, str, int]], smooth: float = 0.5, least_share: float = 0.01):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(at)))
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(at)))
        for lang, gram, n in rows:
            (scripts[gram[1:]] if gram[0] == "\0" else counts[gram])[at[lang]] += n
        totals = sum(counts.values(), np.zeros(len(at))) + smooth * (len(counts) + 1)
        keys = np.array([sum(ord(c) << 21 * i for i, c in enumerate(g)) for g in counts], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        known = np.array(list(counts.values())).reshape(-1, len(at))[order]
        self.logs = np.log((np.vstack([known, np.zeros(len(at))]) + smooth) / totals)  # the last row is for n-grams not seen
        seen = sum(scripts.values(), np.zeros(len(at)))
        fits = {s: c >= least_share * seen for s, c in scripts.items()}
        none = np.ones(len(at), bool)
        barred = round(BARRED * UNIT)
        self.scripts = np.array([np.where(fits[s] if s in fits and fits[s].any() else none, 0, barred) for _, s in SCRIPTS], np.int32)

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of words by language: normalized, and no worse than FLOOR but for languages that lack the word's script.

        They are whole numbers of 1 / UNIT, so that sums of them, and with
        them ties between labels, are the same on every machine.
        """
        out = [np.zeros((0, len(self.langs)), np.int32)]
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            marked = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            total = np.zeros((len(part), len(self.langs)))
            for key, owner in _keys(marked, np.repeat(np.arange(len(part)), sizes)):
                if not len(key):
                    continue
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                at = np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)
                first = np.append(0, np.flatnonzero(np.diff(owner)) + 1)  # a piece of one letter has no pairs
                total[owner[first]] += np.add.reduceat(self.logs[at], first, axis=0)
            total -= total.max(axis=1, keepdims=True)
            total = np.maximum(total - np.log(np.exp(total).sum(axis=1, keepdims=True)), FLOOR)
            first = np.cumsum(sizes) - sizes
            letter = marked[first + (marked[first] == ord("<"))]
            out.append(np.rint(total * UNIT).astype(np.int32) + self.scripts[np.searchsorted(_STARTS, letter, side="right") - 1])
        return np.concatenate(out)


class Scores(dict):
    """Numbers the words of tokens between white space as they come, and scores new words together. Emptied when it gets large, between batches.

    As a dictionary it maps tokens to their numbers; ``count`` and ``flat``
    hold, in the order of those, how many words a token has and which.
    """

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self):
        self.clear()
        self.words: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.model.langs)), np.int32)
        self.count, self.flat, self.sizes = (np.zeros(0, np.int64) for _ in range(3))
        self._fresh()

    def _fresh(self):
        self.new_words, self.new_count, self.new_flat, self.new_sizes = [], [], [], []

    def __missing__(self, token):
        at = self[token] = len(self)
        found = pieces(token)
        self.new_count.append(len(found))
        for start, end, w in found:
            if w not in self.words:
                self.words[w] = len(self.words)
                self.new_words.append(w)
                self.new_sizes.append(end - start)
            self.new_flat.append(self.words[w])
        return at

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text; and of all texts, one after the other, the numbers and sizes of the words. ``matrix`` then has the scores of them all."""
        if len(self) > self.most:
            self.reset()
        tokens = [np.fromiter(map(self.__getitem__, split), np.int64, len(split)) for split in ((t or "").split() for t in texts)]
        each = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in tokens]) if len(each) else each
        if self.new_count:
            self.count, self.flat, self.sizes = (np.append(old, np.array(new, np.int64)) for old, new in ((self.count, self.new_count), (self.flat, self.new_flat), (self.sizes, self.new_sizes)))
            self.matrix = np.concatenate([self.matrix, self.model.score(self.new_words)])
            self._fresh()
        n = self.count[each]
        first = (np.cumsum(self.count) - self.count)[each]
        words = self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.bincount(owner, n, len(texts)).astype(np.int64), words, self.sizes[words]


def viterbi(lengths: np.ndarray, flat: np.ndarray, emit: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words: ``flat`` holds the word numbers of texts of these lengths, one after the other.

    Of paths that score the same, that which keeps its label is taken, then
    that with the first label by name.
    """
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    out = np.zeros(len(flat), np.int16)
    if not len(flat):
        return out
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    active = np.array([np.count_nonzero(size > 0)]) if size[0] == 1 else np.append(np.count_nonzero(size > 0), active[1:])
    state = emit[flat[start[: active[0]]]].astype(np.result_type(emit, np.int64))
    back = [None]
    own = np.arange(emit.shape[1], dtype=np.int16)
    for t in range(1, size[0]):
        a = active[t]
        v = state[:a]
        top = v.argmax(axis=1)
        best = v[np.arange(a), top] - penalty
        stay = v >= best[:, None]
        back.append(np.where(stay, own, top[:, None].astype(np.int16)))
        state[:a] = np.where(stay, v, best[:, None]) + emit[flat[start[:a] + t]]
    now = state.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        out[start[:a] + t] = now[:a]
        if t:
            now[:a] = back[t][np.arange(a), now[:a]]
    return out


def fit(docs: DataFrame, max_fit_docs: int = 20_000, seed: int = 11) -> Model | None:
    """Counts n-grams over a sample of at most about ``max_fit_docs`` texts with a language and a remainder modulo 5 that is not 0.

    The sample is by a hash of the id; all n-grams of its words are kept, so
    what comes to the driver is bounded by the sample. None without any such
    text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select("doc_id", "text", "lang")
    known = known.where(sampled(F.col("doc_id"), min(1.0, max_fit_docs / max(known.count(), 1)), seed))

    def count(batches):
        for batch in batches:
            tokens: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens.update((lang, token) for token in text.split())
            found: Counter = Counter()
            for (lang, token), n in tokens.items():
                for start, end, word in pieces(token):
                    found[lang, "\0" + script(word.lstrip("<")[0])] += n * (end - start)
                    for g in grams(word):
                        found[lang, g] += n
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counted = known.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rows = [(r["lang"], r["gram"], r["n"]) for r in counted.collect()]
    return Model(rows) if rows else None


_CACHE: dict[str, Scores] = {}


def _scores(model: Model, key: str) -> Scores:
    """The cache of this process for the UDF of this ``key``; others are dropped."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Scores(model)
    return _CACHE[key]


@apart("doc_id", "text")
def detect(docs: DataFrame, model: Model | None, penalty: float = 6.0) -> DataFrame:
    """``docs`` with held_out, lang_pred and score.

    lang_pred is the label of most letters (ties: the first by name), score
    their share. Scores of words are whole numbers of 1 / UNIT; where
    labellings score the same, a word rather has the label of the word before
    it, then that which is first by name. Defined results: "und" and 0 if the text is null or has no
    letter, or without a model; repeated rows are labelled each on their own;
    held_out is false for null ids; an empty table gives an empty table; input
    columns named like an output are replaced; a very long text takes a step
    of Viterbi per word and a byte or two per word and language.
    """
    kept = without(docs, "held_out", "lang_pred", "score")
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    key = uuid.uuid4().hex

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        scores, langs, found = _scores(model, key), model.langs, []
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096].to_pylist()
            lengths, flat, sizes = scores.read(part)
            labels = viterbi(lengths, flat, scores.matrix, round(penalty * UNIT))
            owner = np.repeat(np.arange(len(part)), lengths)
            letters = np.bincount(owner * len(langs) + labels, sizes, len(part) * len(langs)).reshape(-1, len(langs))
            total, top = letters.sum(axis=1), letters.argmax(axis=1)
            found += [(langs[k], float(row[k] / n)) if n else ("und", 0.0) for row, k, n in zip(letters, top, total)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    said = label(F.col("text")) if model else F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    whole = kept.select(F.struct("*").alias("_row"), held.alias("held_out"), said.alias("_said"))
    return whole.select("_row.*", "held_out", F.col("_said.lang").alias("lang_pred"), F.col("_said.score").alias("score"))


@apart("text")
def spans(docs: DataFrame, model: Model, penalty: float = 6.0) -> DataFrame:
    """``docs`` with ``lang_spans``: array of (start, end, lang) over code points, runs of words with one label."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    key = uuid.uuid4().hex

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        out, scores = [], _scores(model, key)
        for text in texts.to_pylist():
            lengths, flat, _ = scores.read([text])
            labels = viterbi(lengths, flat, scores.matrix, round(penalty * UNIT))
            runs: list[dict] = []
            # the same tokens, at their places
            words = ((m.start() + a, m.start() + b) for m in TOKEN.finditer(text or "") for a, b, _ in pieces(m[0]))
            for (a, b), k in zip(words, labels, strict=True):
                if runs and runs[-1]["lang"] == model.langs[k]:
                    runs[-1]["end"] = b
                else:
                    runs.append({"start": a, "end": b, "lang": model.langs[k]})
            out.append(runs)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))

    return without(docs, "lang_spans").withColumn("lang_spans", label(F.col("text")))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
