"""Language ID by unigrams over a fixed public vocabulary, summed over all segmentations.

Every language has a probability for each vocabulary piece. The likelihood of a word is the sum over all ways to cut
it into pieces, by a forward pass; a text's score is the sum of its words' logarithms. A word is a whole run of letters, however long:
words of up to SHORT letters go through the lattice together, longer ones (texts without blanks) one by one under a scale. The probabilities are
fitted by expectation-maximisation (forward and backward over the same lattice) on a bounded sample of labelled rows.
Scoring is a map over whole texts: no shuffle, and words are computed once per task and looked up after that.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import FILE, LOCATOR, ROW, read_table, with_locator

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the fit: labelled rows of each language and of all, languages (the most frequent ones), and the letters between which a longer run is cut, for the fit alone.
ROWS_PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES, FIT_RUN = 300, 20_000, 256, 2048
#: Words up to this length can't underflow, however improbable; longer ones are scored under a scale.
SHORT = 32
UNKNOWN, FLOOR, CACHE = 1e-7, 1e-8, 300_000
UND = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The text's runs of letters in lower case; none for null."""
    return _LETTERS.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's ordinary pieces that can stand in a lower-case word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if _LETTERS.fullmatch(p.removeprefix("▁")) and p == p.lower() or p == "▁"})


def _hash(codes: np.ndarray) -> np.ndarray:
    """Of rows of code points."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class Lattice:
    """Finds the pieces of every substring of many words of one length at once."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        h = np.array([int(_hash(_codes([p]))[0]) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], order.astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("pieces whose hashes are equal")

    def edges(self, words: list[str]):
        """(i, j, piece id or -1) for all substrings i..j that are a piece of some word, or one character. Words have one length."""
        codes = _codes(["▁" + w for w in words]).astype(np.uint64) + np.uint64(1)
        n = codes.shape[1]
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _BASE + codes[:, j - 1]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                piece = np.where(self.keys[at] == h, self.ids[at], -1)
                if j == i + 1 or (piece >= 0).any():
                    yield i, j, piece

    def ending(self, codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Row of the table for every string that ends before lo + 1 to hi of one word's codes, by its length from 1 to the longest."""
        n, first = len(self.pieces), max(0, lo + 1 - self.longest)
        own = codes[first:hi].astype(np.uint64) + np.uint64(1)
        out = np.full((hi - lo, self.longest), n + 1, np.int64)
        h = np.zeros(len(own), np.uint64)
        for size in range(1, min(self.longest, len(own)) + 1):
            h = h[: len(own) - size + 1] * _BASE + own[size - 1 :]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            row = np.where(self.keys[at] == h, self.ids[at], n if size == 1 else n + 1)
            ends = np.arange(first + size, hi + 1)
            out[ends[ends > lo] - lo - 1, size - 1] = row[ends > lo]
        return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # pieces + 2 rows, a column for each language: the last two are an unknown character and no piece
    prior: np.ndarray


def _table(counts: np.ndarray) -> np.ndarray:
    pool = counts.sum(axis=1, keepdims=True) + 0.01
    pool /= pool.sum()
    p = (counts + 100 * pool) / (counts.sum(axis=0, keepdims=True) + 100)
    return np.vstack([np.maximum(p, FLOOR), np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def _at(piece: np.ndarray, one: bool, n: int) -> np.ndarray:
    """Row of the table: a single character that is no piece is unknown, a longer string that is none is impossible."""
    return np.where(piece >= 0, piece, n if one else n + 1)


def _by_length(words: list[str]):
    """Indices of the words of up to SHORT letters, those of one length together."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) <= SHORT:
            by.setdefault(len(w), []).append(k)
    for ix in by.values():
        for at in range(0, len(ix), 4096):
            yield np.array(ix[at : at + 4096])


def _forward_long(lattice: Lattice, prob: np.ndarray, word: str, block: int = 1 << 14) -> np.ndarray:
    """Of one word of any length: the sums of the last positions alone are held, and scaled when they get small."""
    codes = _codes(["▁" + word])[0]
    last, log = np.zeros((lattice.longest, prob.shape[1])), np.zeros(prob.shape[1])
    last[0] = 1
    for lo in range(0, len(codes), block):
        for row in lattice.ending(codes, lo, min(len(codes), lo + block)):
            now = (last * prob[row]).sum(axis=0)
            last[1:] = last[:-1].copy()
            last[0] = now
            if now.min() < 1e-100:
                top = last.max(axis=0)
                last /= top
                log += np.log(top)
    return log + np.log(last[0])


def forward(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Logarithm of each word's probability in each language, all segmentations summed."""
    out = np.zeros((len(words), prob.shape[1]))
    for k, w in enumerate(words):
        if len(w) > SHORT:
            out[k] = _forward_long(lattice, prob, w)
    for ix in _by_length(words):
        own = [words[k] for k in ix]
        alpha = np.zeros((len(own[0]) + 2, len(own), prob.shape[1]))
        alpha[0] = 1
        for i, j, piece in lattice.edges(own):
            alpha[j] += alpha[i] * prob[_at(piece, j == i + 1, len(lattice.pieces))]
        out[ix] = np.log(alpha[-1])
    return out


def _expect_long(lattice: Lattice, prob: np.ndarray | None, word: str, count: np.ndarray, expected: np.ndarray) -> None:
    """Adds to expected what one long word says of each piece, in logarithms."""
    codes = _codes(["▁" + word])[0]
    size, most = len(codes), lattice.longest
    rows = lattice.ending(codes, 0, size)
    if prob is None:
        np.add.at(expected, rows, count / size)
        return
    with np.errstate(divide="ignore"):
        p = np.log(prob)[rows]
    alpha, beta = (np.full((size + most, prob.shape[1]), -np.inf) for _ in range(2))
    alpha[most - 1] = beta[size - 1] = 0  # alpha[most - 1 + j] and beta[j - 1] are those of the place before the letter j
    for j in range(size):
        alpha[most + j] = np.logaddexp.reduce(alpha[j : j + most][::-1] + p[j], axis=0)
    for j in range(size - 1, 0, -1):
        ends = np.arange(j, min(size, j + most))
        beta[j - 1] = np.logaddexp.reduce(beta[ends] + p[ends, ends - j], axis=0)
    before = np.stack([alpha[most - 1 - k : most - 1 - k + size] for k in range(most)], axis=1)
    share = np.exp(before + p + beta[:size][:, None, :] - alpha[most + size - 1])
    np.add.at(expected, rows, share * count)


def fit(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The piece probabilities after some rounds of EM. counts: of each word in each language."""
    n = len(lattice.pieces)
    prob, long = None, [k for k, w in enumerate(words) if len(w) > SHORT]
    for _ in range(rounds + 1):
        expected = np.zeros((n + 2, counts.shape[1]))
        for k in long:
            _expect_long(lattice, prob, words[k], counts[k], expected)
        for ix in _by_length(words):
            own, c = [words[k] for k in ix], counts[ix]
            edges = list(lattice.edges(own))
            if prob is None:
                for i, j, piece in edges:
                    np.add.at(expected, _at(piece, j == i + 1, n), c / (len(own[0]) + 1))
                continue
            alpha, beta = (np.zeros((len(own[0]) + 2, len(own), counts.shape[1])) for _ in range(2))
            alpha[0], beta[-1] = 1, 1
            for i, j, piece in edges:
                alpha[j] += alpha[i] * prob[_at(piece, j == i + 1, n)]
            for i, j, piece in reversed(edges):
                beta[i] += beta[j] * prob[_at(piece, j == i + 1, n)]
            scale = c / alpha[-1]
            for i, j, piece in edges:
                row = _at(piece, j == i + 1, n)
                np.add.at(expected, row, alpha[i] * prob[row] * beta[j] * scale)
        prob = _table(expected[:n])
    return prob


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(located: DataFrame, vocabulary: str = VOCABULARY, rows: int = ROWS_PER_LANGUAGE, languages: int = MAX_LANGUAGES) -> Model | None:
    """From text and lang of the rows that aren't held out and have both; None if there are none.

    Of the most frequent languages (ties by name), at most so many, the rows with the smallest hash of their id and place are taken, up to
    rows of each and MAX_ROWS of all. A language's count gives the threshold of the hash, so no task meets more than about twice as many.
    """
    known = located.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("lang", F.col("lang").cast("string"))
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not found:
        return None
    rows = max(1, min(rows, MAX_ROWS // len(found)))
    enough = rows + 8 * int(rows**0.5) + 32
    bounds = located.sparkSession.createDataFrame([(r.lang, min(2**63 - 1, 2**63 * enough // r.n)) for r in found], "lang string, bound long")
    h = F.xxhash64(F.col("doc_id").cast("string"), *LOCATOR).bitwiseAND(F.lit(2**63 - 1))
    near = known.select("lang", "doc_id", *LOCATOR, F.col("text").cast("string").alias("text"), h.alias("h")).join(F.broadcast(bounds), "lang").filter("h <= bound")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", *LOCATOR))
    sample = near.withColumn("k", first).filter(F.col("k") <= rows).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                c = Counter(w[i : i + FIT_RUN] for w in words_of(text) for i in range(0, len(w), FIT_RUN))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    if not table.num_rows:
        return None
    code = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word")}
    (names, li), (own, wi) = ((x.dictionary.to_pylist(), x.indices.to_numpy()) for x in (code["lang"], code["word"]))
    at = {c: np.argsort(np.argsort(np.array(x, object))) for c, x in (("lang", names), ("word", own))}
    counts = np.zeros((len(own), len(names)))
    counts[at["word"][wi], at["lang"][li]] = table.column("n").to_numpy()
    pieces = load_pieces(vocabulary)
    prior = counts.sum(axis=0)
    return Model(sorted(names), pieces, fit(Lattice(pieces), sorted(own), counts), np.log(prior / prior.sum()))


class Scorer:
    """Scores texts; keeps up to CACHE words of up to SHORT letters."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.values = np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) for t in texts]
        if len(self.seen) > CACHE:
            self.clear()
        fresh = set().union(*lists) - self.seen.keys()
        new, long = sorted(w for w in fresh if len(w) <= SHORT), sorted(w for w in fresh if len(w) > SHORT)
        if new:
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.values = np.concatenate([self.values, forward(self.lattice, self.model.prob, new)])
        seen, values, langs, scores = self.seen, self.values, [], []
        if long:
            seen = {**dict(zip(long, range(len(values), len(values) + len(long)), strict=True)), **{w: seen[w] for own in lists for w in own if w in seen}}
            values = np.concatenate([values, forward(self.lattice, self.model.prob, long)])
        for own in lists:
            if not has_letter(own):
                langs.append(UND)
                scores.append(0.0)
                continue
            x = values[[seen[w] for w in own]].sum(axis=0) + self.model.prior
            p = np.exp(x - x.max())
            langs.append(self.model.languages[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


def _held(spark: SparkSession, model: Model | None):
    """A function that gives each task its scorer; the model, of at most MAX_LANGUAGES columns, is broadcast once."""
    if model is None:
        return lambda: lambda texts: ([UND] * len(texts), [0.0] * len(texts))
    shared = spark.sparkContext.broadcast(model)
    return lambda: Scorer(shared.value)


def identify(located: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, locator, lang_pred and score (the posterior probability) of every row.

    und, with score 0, where text is null or has no letter, or where no language was learned.
    """
    scorers = _held(located.sparkSession, model)

    def run(batches):
        scorer = scorers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = scorer(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *LOCATOR)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *LOCATOR, "lang_pred", "score"])

    return located.select(F.col("doc_id").cast("long").alias("doc_id"), *LOCATOR, F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, lang_pred string, score double")


def keep_identified(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without the rows of no language: null texts and those without a letter; its columns stay. One scan, without a shuffle.

    Where no row is labelled no language is learned: every row with a letter stays, as none can be rejected for its language.
    """
    model = learn(with_locator(docs), vocabulary)
    if model is None:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    scorers = _held(docs.sparkSession, model)

    def run(batches):
        scorer = scorers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([lang != UND for lang in scorer(part.column("text").to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = with_locator(read_table(spark, sf_dir, "documents"))
    return identify(located, learn(located)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
