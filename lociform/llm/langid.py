"""Language identification by segmentation-marginalised unigrams.

Each language has a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, computed by
a forward recursion; a text's is the product over its words. Piece probabilities
are learned by expectation-maximisation on word counts of a bounded sample of
labelled texts: at most about ``docs_per_language`` whole texts of each language, chosen by
the hash of the text, and of these at most ``max_types`` distinct words; ``max_languages`` bounds the model.

Defined results: a null text, a text without a letter, or a model without any language gives
``und`` with score 0; ties go to the first language in alphabetical order; extra columns
pass through, those named like an added column are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .common import append_columns, quoted, text_or_empty

#: Runs of letters; a text is scored on these, lower-cased.
WORD = re.compile(r"[^\W\d_]+")
#: A character that no piece covers, in any language.
UNSEEN = 1e-9
#: Words of up to so many characters are scored together, so many at a time.
SHORT, BLOCK = 33, 20_000
#: Of each character's probability, which keeps products over a short word within a double.
SCALE = 1e5
#: The scorer forgets its words when it holds more (or more characters) than this.
CACHED_WORDS, CACHED_CHARS, CACHED_VALUES = 300_000, 6_000_000, 4_800_000
#: Words summed at a time.
SUMMED = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, int]:
    """The vocabulary's ordinary pieces, numbered as there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def edges(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end position the (start, piece) of every piece that ends there; -1: an uncovered character."""
    out: list[list[tuple[int, int]]] = [[]]
    for end in range(1, len(word) + 1):
        found = [(s, pieces[p]) for s in range(max(0, end - longest), end) if (p := word[s:end]) in pieces]
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, -1))
        out.append(found)
    return out


def forward(into: list[list[tuple[int, int]]], p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations, for each column of p; rescaled along the way."""
    unseen = np.full(p.shape[1], UNSEEN)
    alpha, shift = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for end in range(1, len(into)):
        a = np.zeros(p.shape[1])
        for start, piece in into[end]:
            a = a + alpha[start] * (p[piece] if piece >= 0 else unseen)
        alpha.append(a)
        if end % 16 == 0:
            top = np.maximum(np.max(alpha[max(0, end - 15) :], axis=0), 1e-300)
            for k in range(max(0, end - 15), end + 1):
                alpha[k] = alpha[k] / top
            shift = shift + np.log(top)
    return np.log(np.maximum(alpha[-1], 1e-300)) + shift


class Lattices:
    """The segmentations of many short words at once, as flat edge lists.

    A trie of the pieces is walked from all characters of all words together, one character further
    in each step; the edges are then put in order of the place where they end (or begin), and each place is
    one weighted count over the words. A word's sums don't depend on the words beside it.
    """

    def __init__(self, pieces: dict[str, int]):
        letters = sorted({c for p in pieces for c in p})
        number = {c: i for i, c in enumerate(letters)}
        self.size, self.unseen = max(pieces.values(), default=-1) + 1, -1
        self.letters = np.array([ord(c) for c in letters] or [0], np.uint32)
        self.n_letters = max(1, len(letters))
        child: dict[int, int] = {}
        piece = [-1]
        for text, k in pieces.items():
            state = 0
            for c in text:
                key = state * self.n_letters + number[c]
                state = child.get(key, 0)
                if not state:
                    child[key] = state = len(piece)
                    piece.append(-1)
            piece[state] = k
        # keys in order; a place past the end compares unequal to every key
        keys = sorted(child)
        self.keys = np.array([*keys, -1], np.int64)
        self.to = np.array([*(child[k] for k in keys), 0], np.int64)
        self.piece = np.array(piece, np.int64)
        self.depth = max(map(len, pieces), default=0)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, from, to, piece) of every edge, in order of length: places in the word; piece -1 is an uncovered character."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[place] == codes, place, -1)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.cumsum(lengths) - lengths
        stop = np.repeat(first + lengths, lengths)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        out = []
        for d in range(self.depth):
            here = at + d
            going = here < stop[at]
            at, here, state = at[going], here[going], state[going]
            key = state * self.n_letters + letter[here]
            j = np.searchsorted(self.keys[:-1], key)
            going = (self.keys[j] == key) & (letter[here] >= 0)
            at, state = at[going], self.to[j[going]]
            k = self.piece[state]
            found = k >= 0
            if not d:
                bare = np.ones(len(codes), bool)
                bare[at[found]] = False
                bare = np.flatnonzero(bare)
                out.append((bare, np.full(len(bare), 1), np.full(len(bare), -1)))
            out.append((at[found], np.full(int(found.sum()), d + 1), k[found]))
        if not out:
            out.append((at, np.full(len(at), 1), np.full(len(at), -1)))
        at, length, k = (np.concatenate(x) for x in zip(*out, strict=True))
        w = word[at]
        start = at - first[w]
        return w, start, start + length, k

    @staticmethod
    def by_place(place: np.ndarray) -> list[np.ndarray]:
        """The edges at each place, from 0 on."""
        order = np.argsort(place.astype(np.int16), kind="stable")
        return np.split(order, np.searchsorted(place[order], np.arange(1, int(place.max(initial=0)) + 1)))

    def forward(self, edges: tuple[np.ndarray, ...], weight: np.ndarray, n: int) -> np.ndarray:
        """alpha[place, word]: the summed weight of all segmentations up to a place; weight: of each edge."""
        word, start, end, _ = edges
        alpha = np.zeros((int(end.max(initial=0)) + 1, n))
        alpha[0] = 1.0
        for place, e in enumerate(self.by_place(end)):
            if place:
                alpha[place] = np.bincount(word[e], alpha[start[e], word[e]] * weight[e], n)
        return alpha

    def backward(self, edges: tuple[np.ndarray, ...], weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """beta[place, word]: the summed weight of all segmentations from a place to the word's end."""
        word, start, end, _ = edges
        beta = np.zeros((int(end.max(initial=0)) + 1, len(lengths)))
        beta[lengths, np.arange(len(lengths))] = 1.0
        for place, e in reversed(list(enumerate(self.by_place(start)))):
            beta[place] += np.bincount(word[e], beta[end[e], word[e]] * weight[e], len(lengths))
        return beta

    def weights(self, edges: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
        """Of each edge under the piece probabilities p (the last: an uncovered character), times SCALE for each character."""
        _, start, end, k = edges
        return p[k] * SCALE ** (end - start)

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, columns of p): the log of the summed probability of all segmentations."""
        edges, out = self.edges(words), np.zeros((len(words), p.shape[1]))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in range(p.shape[1]):
            alpha = self.forward(edges, self.weights(edges, p[:, k]), len(words))
            out[:, k] = np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300)) - lengths * np.log(SCALE)
        return out

    def expect(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the words, weighted by their counts."""
        edges = self.edges(words)
        word, start, end, k = edges
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        weight = self.weights(edges, p)
        alpha, beta = self.forward(edges, weight, len(words)), self.backward(edges, weight, lengths)
        whole = alpha[lengths, np.arange(len(words))]
        share = np.divide(counts, whole, out=np.zeros(len(words)), where=whole > 0)
        covered = k >= 0
        posterior = alpha[start, word] * weight * beta[end, word] * share[word]
        return np.bincount(k[covered], posterior[covered], self.size)


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # vocabulary x languages, float32
    vocabulary: str


def count_words(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n): words of each slice are counted in the map, so few rows are shuffled.

    A word has its space before it; one longer than SHORT characters, as in scripts without spaces, is counted in runs of that length.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        from collections import Counter

        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            rows = [(lang, s[i : i + SHORT], n) for lang, c in found.items() for w, n in c.items() for s in ("▁" + w,) for i in range(0, len(s), SHORT)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=schema.fieldNames())

    return map_arrow(df.select(F.col(quoted(lang_col)).cast("string"), text_or_empty(text_col)), run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(lattices: Lattices, n_pieces: int, counts: dict[str, float], rounds: int) -> np.ndarray:
    """Piece probabilities by expectation-maximisation; one count is spread over all pieces."""
    p = np.full(lattices.size + 1, 1.0 / n_pieces)
    words, n = list(counts), np.fromiter(counts.values(), float, len(counts))
    for _ in range(rounds):
        p[-1] = UNSEEN
        expected = np.zeros(lattices.size)
        for i in range(0, len(words), BLOCK):
            expected += lattices.expect(words[i : i + BLOCK], n[i : i + BLOCK], p)
        p[:-1] = (expected + 1.0 / n_pieces) / (expected.sum() + 1.0)
    return p[:-1]


def train(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str | None = None,
    docs_per_language: int = 250,
    max_types: int = 120_000,
    max_languages: int = 256,
    rounds: int = 2,
) -> LanguageModel:
    """Learn from the labelled rows of df.

    The sample is a hash sample of texts whose rate is set by each language's number of rows, so what reaches
    the driver is bounded by the parameters: the ``max_languages`` languages with the most rows, about
    ``docs_per_language`` whole texts of each, and of their words the most frequent, ``max_types`` over the number of
    languages for each. A language of which no word is sampled is not learned.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = load_pieces(vocabulary)
    labelled = df.where(F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    sizes = labelled.groupBy(F.col(quoted(lang_col)).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    lattices = Lattices(pieces)
    if not sizes:
        return LanguageModel([], np.zeros((lattices.size, 0), np.float32), vocabulary)
    parts = F.pmod(F.xxhash64(F.col(quoted(text_col))), F.lit(1_000_000))
    lang = F.col(quoted(lang_col)).cast("string")
    chosen = F.lit(False)
    for r in sizes:
        rate = min(1.0, docs_per_language / r["count"])
        chosen = chosen | ((lang == r["lang"]) & (parts < max(1, math.ceil(rate * 1_000_000))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = count_words(labelled.where(chosen), text_col, lang_col).withColumn("place", place).where(F.col("place") <= max(1, max_types // len(sizes)))
    counts: dict[str, dict[str, float]] = {}
    for r in words.select("lang", "word", "n").collect():
        counts.setdefault(r["lang"], {})[r["word"]] = float(r["n"])
    languages = sorted(counts)
    table = np.zeros((lattices.size, len(languages)))
    for k, name in enumerate(languages):
        table[:, k] = learn(lattices, len(pieces), dict(sorted(counts[name].items())), rounds)
    return LanguageModel(languages, table.astype(np.float32), vocabulary)


class Scorer:
    """Texts to (language, score). Words are scored once and remembered, in a memory of bounded size.

    A word's scores depend on the word alone and a text's on its words in order, so
    equal texts have equal results whatever came before them.
    """

    def __init__(self, model: LanguageModel):
        self.model = model
        self.pieces = load_pieces(model.vocabulary)
        self.longest = max(map(len, self.pieces), default=0)
        self.lattices = Lattices(self.pieces)
        self.n = len(model.languages)
        self.p = np.vstack([model.probabilities.astype(np.float64), np.full((1, self.n), UNSEEN)])
        self.room = max(1, min(CACHED_WORDS, CACHED_VALUES // max(1, self.n)))
        self.index: dict[str, int] = {}
        self.rows, self.chars = np.zeros((self.room + 1, self.n)), 0

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probabilities; of words without a letter: 0."""
        out = np.zeros((len(words), self.n))
        real = [i for i, w in enumerate(words) if w.isalpha() or any(map(str.isalpha, w))]
        short = [i for i in real if len(words[i]) < SHORT]
        for i in range(0, len(short), BLOCK):
            some = short[i : i + BLOCK]
            out[some] = self.lattices.scores(["▁" + words[j] for j in some], self.p)
        for i in real:
            if len(words[i]) >= SHORT:
                out[i] = forward(edges("▁" + words[i], self.pieces, self.longest), self.p)
        return out

    def learn(self, words: list[str]) -> None:
        """Have all words at hand; row 0 stands for those without a letter."""
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.index]
        size = sum(map(len, new))
        if len(self.index) + len(new) > self.room or self.chars + size > CACHED_CHARS:
            self.index, self.chars, new = {}, 0, list(distinct)
            size = sum(map(len, new))
            if len(new) > self.room or len(self.rows) > self.room + 1:  # one slice's words are always held
                self.rows = np.zeros((max(self.room, len(new)) + 1, self.n))
        made, base = self.scores(new), len(self.index) + 1
        self.rows[base : base + len(new)] = made
        self.index.update((w, base + k if made[k].any() else 0) for k, w in enumerate(new))
        self.chars += size

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words: list[str] = []
        ends = []
        for text in texts:
            if text and self.n:
                words += WORD.findall(text.lower())
            ends.append(len(words))
        self.learn(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        langs, scores, begin = [], [], 0
        for end in ends:
            own, begin = at[begin:end], end
            n = int(np.count_nonzero(own))
            if not n:
                langs.append("und")
                scores.append(0.0)
                continue
            total = np.zeros(self.n)
            for i in range(0, len(own), SUMMED):
                total += self.rows[own[i : i + SUMMED]].sum(axis=0)
            best = int(np.argmax(total))
            # The posterior with evenly weighted languages; texts count as 30 words at most, for a score that orders long texts.
            z = (total - total[best]) * (min(n, 30) / n)
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(z).sum()))
        return langs, scores


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with a predicted language and its score: a map without a shuffle. The model's
    size is that of the vocabulary times the languages."""
    spread = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    held: dict = {}

    def kernel(texts: pa.Array) -> list[pa.Array]:
        if "k" not in held:
            held["k"] = Scorer(spread.value)
        langs, scores = held["k"](texts.to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(df, [F.col(quoted(text_col)).cast("string")], fields, kernel)


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")), F.lit(of))
