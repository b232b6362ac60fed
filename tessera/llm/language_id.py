"""Language ID (operator 2): segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, by a
forward algorithm; a text's is the product over its words, and its language the
one with the largest posterior. Piece probabilities are learned by expectation
maximisation with the matching backward pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batch, stored, table

#: Runs of letters (and of the few number signs that count as word characters, sorted out below).
LETTERS = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
#: Letters up to which words are scored side by side, without rescaling; longer ones are learned from in parts of this length.
LONG_WORD = 40
#: Characters of text held as words at once.
PIECE = 1 << 20
#: Probability of a character that no piece of the vocabulary covers.
UNKNOWN = 1e-7
MARK = "▁"
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Numbered pieces, found by the hash of their characters in a table of open addresses."""

    BITS = 20
    MULTIPLIER, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.hashes = np.zeros(1 << self.BITS, np.uint64)
        self.numbers = np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for number, piece in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * self.MULTIPLIER + np.uint64(ord(c))
                at = int(h * self.SPREAD >> np.uint64(64 - self.BITS))
            for probe in range(1 << self.BITS):
                place = (at + probe) & ((1 << self.BITS) - 1)
                if self.numbers[place] < 0:
                    break
            self.hashes[place], self.numbers[place] = h, number
            self.probes = max(self.probes, probe + 1)

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of these hashes, -1 for none."""
        at = (h * self.SPREAD >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.hashes[at] == h, self.numbers[at], -1)
        for probe in range(1, self.probes):
            other = (at + probe) & ((1 << self.BITS) - 1)
            hit = self.hashes[other] == h
            if hit.any():
                out = np.where(hit & (out < 0), self.numbers[other], out)
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The lower-case pieces of letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Vocabulary(sorted(p for p in pieces if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())))


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def marked(word: str) -> str:
    """The word's letters after the word mark; nothing without a letter."""
    word = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    return MARK + word if word else ""


def parts_of(word: str) -> list[str]:
    """A marked word in parts of at most LONG_WORD letters, to learn from; none without a letter."""
    word = marked(word)
    return [word[i : i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]


def lattice(group: list[str], pieces: Vocabulary) -> np.ndarray:
    """[word, start, length - 1] -> piece number or -1, for words of one length."""
    n = len(group[0])
    most = min(n, pieces.longest)
    codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n).astype(np.uint64)
    found = np.full((len(group), n, most), -1, np.int32)
    h = np.zeros_like(codes)
    with np.errstate(over="ignore"):
        for k in range(1, most + 1):
            h = h[:, : n - k + 1] * Vocabulary.MULTIPLIER + codes[:, k - 1 :]
            found[:, : n - k + 1, k - 1] = pieces.find(h)
    return found


def forward(found: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]; probs[-1] serves uncovered characters only."""
    w, n, most = found.shape
    alpha = np.zeros((n + 1, w, probs.shape[1]))
    alpha[0] = 1
    for end in range(1, n + 1):
        for k in range(1, min(end, most) + 1):
            ids = found[:, end - k, k - 1]
            p = probs[ids]
            if k > 1:
                p = p * (ids >= 0)[:, None]
            alpha[end] += alpha[end - k] * p
    return alpha


def by_length(items: list[str], most: int = 4096):
    """(indices, words) of equal length, at most `most` at a time."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        groups.setdefault(len(x), []).append(i)
    for found in groups.values():
        for a in range(0, len(found), most):
            yield found[a : a + most], [items[i] for i in found[a : a + most]]


def long_score(word: str, pieces: Vocabulary, probs: np.ndarray, block: int = 4096) -> np.ndarray:
    """The same for one word of any length: the forward sums are divided by the current one at every letter."""
    most, log = pieces.longest, np.zeros(probs.shape[1])
    ahead = np.zeros((most + 1, probs.shape[1]))
    ahead[0] = 1
    for a in range(0, len(word), block):
        part = word[a : a + block + most - 1]
        found = lattice([part], pieces)[0]
        n = min(block, len(word) - a)
        p = np.zeros((n, most, probs.shape[1]))
        p[:, : found.shape[1]] = probs[found[:n]] * ((found[:n] >= 0) | (np.arange(found.shape[1]) == 0))[:, :, None]
        for step in p:
            log += np.log(ahead[0])
            ahead[1:] = ahead[1:] / ahead[0] + step
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
    return log + np.log(ahead[0])


def word_scores(items: list[str], pieces: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """log probability of each word (all segmentations summed) in each language; zeros without letters."""
    out = np.zeros((len(items), probs.shape[1]))
    words = [marked(w) for w in items]
    short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
    for index, group in by_length([words[i] for i in short]):
        alpha = forward(lattice(group, pieces), probs)
        out[[short[i] for i in index]] = np.log(alpha[-1])
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = long_score(w, pieces, probs)
    return out


def expected(items: list[str], weights: np.ndarray, pieces: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words of one language (probs has one column)."""
    out = np.zeros(len(probs))
    for index, group in by_length(items):
        found = lattice(group, pieces)
        w, n, most = found.shape
        alpha = forward(found, probs)[:, :, 0]
        beta = np.zeros((n + 1, w))
        beta[n] = 1
        scale = weights[index] / (alpha[n] + 1e-300)
        for start in range(n - 1, -1, -1):
            for k in range(1, min(n - start, most) + 1):
                ids = found[:, start, k - 1]
                p = probs[ids, 0] * ((ids >= 0) | (k == 1))
                beta[start] += p * beta[start + k]
                np.add.at(out, ids, alpha[start] * p * beta[start + k] * scale)
    return out[:-1]


class Model:
    """Languages and, in the same order, columns of piece probabilities (last row: uncovered characters)."""

    def __init__(self, languages: list[str], probs: np.ndarray):
        self.languages, self.probs = languages, probs


def train(labelled: DataFrame, rows_per_language: int = 1500, rounds: int = 3, smoothing: float = 0.1, path: str | None = None) -> Model:
    """A model from text and non-null lang of labelled (doc_id, text, lang).

    It is fitted on a sample whose bound is rows_per_language: the expected
    number of rows taken of each language, by the hash of doc_id; the words of a
    sampled text are all counted. The word table and one expected count a piece
    and language are all that a round moves; the model's size is that of the
    vocabulary times the number of languages.
    """
    path = path or vocabulary_path()
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((len(vocabulary(path)) + 1, 0)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / totals[lang]))])
    taken = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, Counter()).update(words(text.as_py()))
        for lang, counter in held.items():
            parts = Counter()
            for word, n in counter.items():
                for p in parts_of(word):
                    parts[p] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(list(parts), pa.string()), pa.array(list(parts.values()), pa.int64())], names=["lang", "word", "n"])

    counted = taken.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted.repartition(F.col("lang"), F.pmod(F.hash("word"), F.lit(8))))
    size = len(vocabulary(path))
    probs = np.full((size + 1, len(languages)), 1.0 / size)
    probs[-1] = UNKNOWN
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(probs)

        def expect(frames, sent=sent):
            pieces = vocabulary(path)
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    at = languages.index(lang)
                    got = expected(part["word"].tolist(), part["n"].to_numpy(float), pieces, sent.value[:, at : at + 1])
                    some = np.flatnonzero(got > 0)
                    yield pd.DataFrame({"lang": at, "piece": some, "n": got[some]})

        sums = counted.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        table_ = np.full((size, len(languages)), smoothing)
        table_[sums["piece"], sums["lang"]] += sums["n"]
        probs = np.vstack([table_ / table_.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
        sent.unpersist()
    return Model(languages, probs)


class Scorer:
    """Languages, posteriors and log probabilities a letter of texts; remembers the scores of up to most_cached words."""

    def __init__(self, pieces: Vocabulary, languages: list[str], probs: np.ndarray, most_cached: int = 150_000):
        self.pieces, self.languages, self.probs, self.most_cached = pieces, languages, probs, most_cached
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.languages))), np.zeros(0, np.int64)

    def add(self, totals: np.ndarray, letters: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        """Adds the scores and letters of words to the totals of their texts."""
        if len(self.known) > self.most_cached:
            self.forget()
        known = self.known
        fresh = sorted(set().union(*(found for _, found in held)).difference(known))
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        self.scores = np.vstack([self.scores, word_scores(fresh, self.pieces, self.probs)])
        self.letters = np.append(self.letters, [max(0, len(marked(w)) - 1) for w in fresh]).astype(np.int64)
        for i, found in held:
            ids = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
            totals[i] += self.scores[ids].sum(axis=0)
            letters[i] += self.letters[ids].sum()

    def __call__(self, values) -> tuple[list[str], list[float], list[float], list[int]]:
        """The prediction, its posterior, its log probability a letter, and the letters of each text."""
        n = len(values)
        totals, letters = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        held, size = [], 0
        for i, value in enumerate(values):
            for part in pieces_of((value.as_py() if isinstance(value, pa.Scalar) else value) or ""):
                held.append((i, words(part)))
                size += len(part)
                if size >= PIECE:
                    self.add(totals, letters, held)
                    held, size = [], 0
        if held:
            self.add(totals, letters, held)
        if not self.languages:
            return ["und"] * n, [0.0] * n, [0.0] * n, letters.tolist()
        best = totals.argmax(axis=1)
        top = totals[np.arange(n), best]
        some = letters > 0
        posterior = np.where(some, 1 / np.exp(totals - top[:, None]).sum(axis=1), 0.0)
        preds = [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
        return preds, posterior.tolist(), (top / np.maximum(letters, 1)).tolist(), letters.tolist()


def pieces_of(text: str):
    """The text in pieces of about PIECE characters that end before something other than a letter."""
    at = 0
    while len(text) - at > PIECE:
        gap = GAP.search(text, at + PIECE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, lang_pred, score of every row; the whole text counts and nothing else.

    score is the posterior of the predicted language under equal priors. Null
    texts and those without a letter are `und` with score 0, as are all without
    a language learned. A map without shuffle; the model is broadcast, bounded by
    vocabulary times languages. Repeated rows and null keys give rows like any
    others. Ties go to the first language in alphabetical order.
    """
    path = path or vocabulary_path()
    languages = model.languages
    sent = docs.sparkSession.sparkContext.broadcast(model.probs)

    def run(batches):
        scorer = Scorer(vocabulary(path), languages, sent.value)
        for b in batches:
            preds, values, _, _ = scorer(b.column(1))
            yield batch(OUT, {"doc_id": b.column(0), "lang_pred": preds, "score": values})

    out = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", key)


def drop_unidentified(docs: DataFrame, model: Model, least_score: float = 0.5, least_fit: float = -7.0, long: int = 50) -> DataFrame:
    """docs without the rows that no language of the model fits; all columns as they are.

    A text without a letter is rejected. So is one of `long` letters or more if
    the posterior of its best language is below least_score, or if that language
    gives its letters a mean log probability below least_fit: text of the
    languages learned has about -2 to -4, letters that no piece covers about -16.
    Shorter texts are too unsure to reject. Where no language could be learned,
    all rows stay.
    """
    if not model.languages:
        return docs
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    kept = rows.where(accepter(model, least_score, least_fit, long)("text"))
    return kept.select(*[F.col("row")[c].alias(c) for c in names])


def accepter(model: Model, least_score: float, least_fit: float, long: int, path: str | None = None):
    """Whether some language fits, as a function of a text column."""
    path = path or vocabulary_path()
    languages, probs = model.languages, model.probs

    def accept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(vocabulary(path), languages, probs)
        for texts in batches:
            # one text after another, never a batch of them as Python strings
            _, scores, fits, letters = (np.array(x) for x in scorer(texts))
            yield pa.array((letters > 0) & ((letters < long) | ((scores >= least_score) & (fits >= least_fit))))

    return F.arrow_udf(accept, T.BooleanType())


def held_out(key: str = "doc_id", mod: int = 4, rest: int = 2):
    """Whether crc32 of the key as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
