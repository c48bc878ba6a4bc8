"""Languages of mails and of their segments, with a confidence.

A language's model is a unigram distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a paragraph is scored
by its words. The distributions are fitted by expectation-maximisation (forward-backward counts) on a bounded
sample of labelled mails, TRAIN_DOCS at most; paragraphs are then reassigned by the fitted models and the
models fitted again, so wrong labels and mixed mails in the sample wash out. Everything else sees all mails.

Defined results: null, empty and blank mails and those without own words have no segment and no language;
labels outside the six languages, null or filler count as missing or wrong as they stand; repeated mails each
get their rows; confidence is the posterior of the language among the six, 1/6 where nothing speaks for any.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.mail import own_paragraphs
from trellis.llm.tokens import TOKENIZERS

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
TRAIN_DOCS = 2000
MIN_WORDS = 15
UNSURE_WORDS, UNSURE = 3, 0.99
KNOWN_WORDS = 400_000  # words whose scores a worker remembers
LONGEST_PIECE = 12
RARE = 3  # training words of a language seen less often are left out: most are invented names
FLOOR = 1e-7
LONG_WORD = 40  # letters, up to which plain products stay in range
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ADDRESS = re.compile(r"\S+@\S+|https?://\S+")
START = "▁"


def paragraph_words(paragraph: str) -> list[str]:
    return WORD.findall(ADDRESS.sub(" ", paragraph).lower())


def vocabulary(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> set[str]:
    """Lower-case letter pieces of the public vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return {p for p in pieces if len(p) <= LONGEST_PIECE and p == p.lower() and (WORD.fullmatch(p.lstrip(START)) or p == START)}


class Model:
    """logs: per piece, a row of log probabilities by language."""

    def __init__(self, probabilities: dict[str, np.ndarray]) -> None:
        self.p = probabilities
        self.known: dict[str, int] = {}  # rows of scored words
        self.scores = np.zeros((1024, len(LANGUAGES)))
        self.none = np.full(len(LANGUAGES), FLOOR)

    def __reduce__(self) -> tuple:
        return Model, (self.p,)

    def spans(self, word: str) -> list[tuple[int, int, str, np.ndarray]]:
        """Pieces of a word; a single letter outside the vocabulary is a piece of the same small probability in each language."""
        w, out = START + word, []
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - LONGEST_PIECE), j):
                p = self.p.get(w[i:j])
                if p is not None or j == i + 1:
                    out.append((i, j, w[i:j], self.none if p is None else p))
        return out

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word by language, summed over its segmentations."""
        forward = [np.zeros(len(LANGUAGES)) for _ in range(len(word) + 2)]
        forward[0] = np.ones(len(LANGUAGES))
        scale, at = np.zeros(len(LANGUAGES)), 0
        for i, j, _, p in self.spans(word):
            if j != at:
                if at % 24 == 23:  # a long word: keep the last values in range
                    top = np.maximum(forward[at], 1e-300)
                    scale += np.log(top)
                    for k in range(max(0, at - LONGEST_PIECE), at + 1):
                        forward[k] = forward[k] / top
                at = j
            forward[j] = forward[j] + forward[i] * p
        return np.log(np.maximum(forward[-1], 1e-300)) + scale

    def row(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known = {}
            k = self.known[word] = len(self.known)
            if k >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[k] = self.word(word)
        return k

    def paragraph(self, words: list[str]) -> tuple[int, float]:
        """The best language and its posterior."""
        total = np.zeros(len(LANGUAGES))
        for k in range(0, len(words), KNOWN_WORDS // 2):
            if len(self.known) > KNOWN_WORDS // 2:  # room for all words of this run
                self.known = {}
            rows = [self.row(w) for w in words[k : k + KNOWN_WORDS // 2]]  # may replace the table of scores
            total += self.scores[rows].sum(axis=0)
        best = int(total.argmax())
        return best, float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _log_posteriors(spans: list[tuple[int, int, str, float]], size: int) -> list[float]:
    """The probability of each span in a word's segmentations."""
    f, b = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    f[0] = b[size] = 0.0
    for i, j, _, p in spans:
        f[j] = np.logaddexp(f[j], f[i] + np.log(p))
    for i, j, _, p in reversed(spans):
        b[i] = np.logaddexp(b[i], b[j] + np.log(p))
    return [float(np.exp(f[i] + np.log(p) + b[j] - f[size])) for i, j, _, p in spans]


def _counts(words: Counter, model: Model, lang: int) -> dict[str, float]:
    """Expected piece counts of one language: forward-backward over every word's segmentations."""
    out: dict[str, float] = defaultdict(float)
    for word, n in words.items():
        spans = [(i, j, s, p[lang]) for i, j, s, p in model.spans(word)]
        size = len(word) + 1
        if size > LONG_WORD:  # in logarithms, as its sums would leave the range
            for (_, _, s, _), x in zip(spans, _log_posteriors(spans, size), strict=True):
                out[s] += n * x
            continue
        f, b = [0.0] * (size + 1), [0.0] * (size + 1)
        f[0] = b[size] = 1.0
        for i, j, _, p in spans:
            f[j] += f[i] * p
        for i, j, _, p in reversed(spans):
            b[i] += b[j] * p
        for i, j, s, p in spans:
            out[s] += n * f[i] * p * b[j] / f[size]
    return out


def _fit(by_language: list[Counter], pieces: set[str], rounds: int = 3) -> Model:
    seen: list[dict[str, float]] = []
    for words in by_language:
        own: dict[str, float] = defaultdict(float)
        for word, n in words.items():
            w = START + word
            for j in range(1, len(w) + 1):
                for i in range(max(0, j - LONGEST_PIECE), j):
                    if w[i:j] in pieces:
                        own[w[i:j]] += n * (j - i)
        seen.append(own)
    for k in range(rounds + 1):
        table = {s: np.full(len(LANGUAGES), FLOOR) for own in seen for s in own}
        for lang, own in enumerate(seen):
            total = sum(own.values()) + 0.1 * len(table)
            for s in table:
                table[s][lang] = (own.get(s, 0.0) + 0.1) / total if total else FLOOR
        model = Model(table)
        if k < rounds:
            seen = [{s: x for s, x in _counts(words, model, lang).items() if s in pieces} for lang, words in enumerate(by_language)]
    return model


def train(samples: list[tuple[str, list[str]]], pieces: set[str]) -> Model:
    """From (language, paragraphs): fitted, paragraphs reassigned, fitted again."""
    texts = [(LANGUAGES.index(lang), words) for lang, paragraphs in samples if lang in LANGUAGES for p in paragraphs if (words := paragraph_words(p))]
    model = Model({})
    for _ in range(2):
        by_language = [Counter() for _ in LANGUAGES]
        for lang, words in texts:
            by_language[lang].update(words)
        model = _fit([Counter({w: n for w, n in c.items() if n >= RARE}) or c for c in by_language], pieces)
        texts = [(model.paragraph(words)[0], words) for _, words in texts]
    return model


def normal_label(column: str = "lang") -> F.Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(column, F.lit("")), r"^([^-_]*)", 1)))


def fit_on(documents: DataFrame, train_docs: int = TRAIN_DOCS, path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> Model:
    """Fits on at most train_docs labelled mails, drawn by a hash of the id."""
    labelled = documents.where(normal_label().isin(*LANGUAGES) & F.col("text").isNotNull())
    share = min(1.0, 1.2 * train_docs / max(1, labelled.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own_paragraphs(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["lang", "paragraphs"])

    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(normal_label().alias("lang"), "text")
    rows = drawn.mapInArrow(run, "lang string, paragraphs array<string>").limit(train_docs).collect()
    return train(sorted((r.lang, r.paragraphs) for r in rows), vocabulary(path))


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, label, segment, lang, confidence, n_words: runs of paragraphs of one language in each mail's own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last, k = None, 0
                scored = [(*model.paragraph(words), words) for p in own_paragraphs(text) if (words := paragraph_words(p))]
                for at, (lang, confidence, words) in enumerate(scored):
                    if len(words) <= UNSURE_WORDS and confidence < UNSURE and len(scored) > 1:  # a greeting that is mostly a name goes with its neighbour
                        lang = scored[at + 1][0] if at + 1 < len(scored) else scored[at - 1][0]
                    if lang == last:
                        n = out[-1][5]
                        out[-1] = (*out[-1][:4], (out[-1][4] * n + confidence * len(words)) / (n + len(words)), n + len(words))
                    else:
                        out.append((doc_id, label, k, LANGUAGES[lang], confidence, len(words)))
                        last, k = lang, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "label", "segment", "lang", "confidence", "n_words"])

    return documents.select("doc_id", normal_label().alias("label"), "text").mapInArrow(run, "doc_id bigint, label string, segment int, lang string, confidence double, n_words int")


def document_languages(parts: DataFrame) -> DataFrame:
    """doc_id, label, lang, n_words, confidence: the languages with MIN_WORDS words or more in a mail."""
    by = parts.groupBy("doc_id", "label", "lang").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    return by.where(F.col("n_words") >= MIN_WORDS)


def mislabelled(languages: DataFrame) -> DataFrame:
    """Rows of the mails whose label is missing or wrong or which have several languages."""
    docs = languages.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # at most six a mail
    bad = F.col("label").isin("", "und", "??") | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return docs.where(bad).select("doc_id", F.explode("langs").alias("lang"))
