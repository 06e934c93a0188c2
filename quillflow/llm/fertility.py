"""Quality rules on tokeniser fertility, beside counts of words, symbols, lines and repeats.

A public subword vocabulary was fitted to ordinary text, so ordinary text costs few tokens per
character, hardly any byte fallback, and its tokens are varied. Measured per document:

* chars_per_token: code points in words per token;
* byte_share: tokens that are single bytes, as a share of all tokens;
* token_entropy: entropy of the document's tokens in bits, relative to the largest value that its
  number of tokens and the vocabulary allow (1: all different, 0: always the same).

A document is rejected when a measure leaves the band of its language (``lang``), or, for an
unknown language, the band of its script (the script of most of its letters). Short
documents say little about their tokens: bands apply from ``MIN_TOKENS`` tokens on.

Lower limits of the languages come from labelled documents (``fitted_bands`` of the table labels at
sf0.1): ``CLEAN_BELOW`` of the clean documents of a language have fewer characters per token, and none a
lower entropy, which separates less. Upper limits are wide, as noise has few characters per token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.bpe import slices
from quillflow.llm.common import fresh, per_worker, trim_worker
from quillflow.llm.words import mix, word_hashes

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
MIN_TOKENS = 50
CACHE_ENTRIES, CACHED_LENGTH = 400_000, 64
_SYMBOLS = b"#*$%&|<>"
_BLANKS = " \t\n\v\f\r"


class Band(NamedTuple):
    """Limits that a document's measures must keep, both ends included."""

    min_chars: float
    max_chars: float
    max_byte_share: float
    min_entropy: float


CLEAN_BELOW = 0.01
# By language code; then by script, for languages without an entry. Latin has the least limits of the
# languages; there were no documents to fit the other scripts to.
LANGUAGE_BANDS = {"en": Band(2.08, 7.0, 0.05, 0.52), "de": Band(2.10, 7.0, 0.05, 0.50),
                  "fr": Band(1.85, 7.0, 0.05, 0.49), "es": Band(1.80, 7.0, 0.05, 0.53)}
SCRIPT_BANDS = {
    "latin": Band(1.80, 8.0, 0.10, 0.49), "cyrillic": Band(1.2, 7.0, 0.10, 0.35),
    "greek": Band(0.8, 6.0, 0.30, 0.35), "arabic": Band(0.8, 6.0, 0.30, 0.35), "hebrew": Band(0.8, 6.0, 0.30, 0.35),
    "cjk": Band(0.3, 4.0, 0.80, 0.30), "other": Band(0.2, 8.0, 0.95, 0.30),
}
# First and last code point of the scripts that have a band.
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
            ("arabic", 0x600, 0x6FF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF))
_LETTERS = re.compile(r"[^\W\d_]")

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean")


class Pieces:
    """Subword ids per blank-separated piece of text, from a sentencepiece model, with a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, tokenized piece by piece (merges never reach across a blank)."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        distinct = set().union(*split)
        ids = dict(zip(distinct, map(self.known.get, distinct)))
        new = [p for p, found in ids.items() if found is None]
        if new:
            learnt = {n: np.array(i, "<u2").tobytes() for n, i in zip(new, self.model.encode(new, num_threads=1))}
            ids.update(learnt)
            short = {k: v for k, v in learnt.items() if len(k) <= CACHED_LENGTH}
            if len(self.known) + len(short) > CACHE_ENTRIES:
                self.known.clear()
            self.known.update(short)
        return [np.frombuffer(b"".join(map(ids.__getitem__, pieces)), "<u2") for pieces in split]


def pieces_of(path: str) -> Pieces:
    return per_worker("vocabulary", ("pieces", path), lambda: Pieces(path))


def script_of(text: str) -> str:
    """Script of most letters; "other" without letters or for a script without a band."""
    counts: dict[str, int] = {}
    for letter in _LETTERS.findall(text):
        code = ord(letter)
        name = next((n for n, a, b in _SCRIPTS if a <= code <= b), "other")
        counts[name] = counts.get(name, 0) + 1
    return max(sorted(counts), key=counts.__getitem__) if counts else "other"


def token_measures(ids: np.ndarray, is_byte: np.ndarray, word_chars: int) -> tuple[float, float, float]:
    if not len(ids):
        return 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    share = counts / len(ids)
    most = np.log2(min(len(ids), len(is_byte)))
    entropy = float(-(share * np.log2(share)).sum() / most) if most > 0 else 1.0
    return word_chars / len(ids), float(is_byte[ids].mean()), entropy


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    seen = np.zeros(n, np.uint64)
    for k in range(window):
        seen = mix(seen + hashes[k:k + n])
    order = np.argsort(seen, kind="stable")
    same = seen[order[1:]] == seen[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            if line in seen:
                count += 1
            else:
                seen.add(line)
    return count


def in_band(lang: str | None, text: str, chars: float, byte_share: float, entropy: float,
            languages=None, scripts=None) -> bool:
    languages = LANGUAGE_BANDS if languages is None else languages
    scripts = SCRIPT_BANDS if scripts is None else scripts
    band = languages.get(lang) or scripts[script_of(text)]
    return band.min_chars <= chars <= band.max_chars and byte_share <= band.max_byte_share and (
        entropy >= band.min_entropy)


def quality(path: str, languages: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None):
    """A function of the columns (text, lang) that gives the struct ``FIELDS``.

    ``path`` is the sentencepiece model on the executors. Null texts have no words (base_failed); a
    null or unknown language is judged by script. Nothing is shuffled, and a task holds one
    Arrow batch.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def measure(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(path)
        for texts, langs in columns:
            rows = []
            texts = ["" if t is None else t for t in texts]
            langs = [*langs]
            for a, b in slices(texts):
                part = texts[a:b]
                data = [t.encode("utf-8", "surrogatepass") for t in part]
                hashes, first = word_hashes(data, lower=False)
                for i, (text, raw, ids) in enumerate(zip(part, data, pieces.ids(part))):
                    n = int(first[i + 1] - first[i])
                    chars = len(text) - sum(map(text.count, _BLANKS))
                    symbols = sum(raw.count(c) for c in _SYMBOLS)
                    repeats = repeated_words(hashes[first[i]:first[i + 1]])
                    measures = token_measures(ids, pieces.is_byte, chars)
                    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
                    kept = not failed and (len(ids) < MIN_TOKENS or in_band(
                        langs[a + i], text, *measures, languages, scripts))
                    rows.append((n, chars, symbols, repeated_lines(text), repeats, len(ids), *measures, failed, kept))
            yield pd.DataFrame(rows, columns=names)
        trim_worker()

    return measure


def quality_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, the fields of ``FIELDS``) for every row of ``docs`` (doc_id, text, lang).

    Repeated rows are judged alike, other columns are ignored, an empty table gives an empty
    result; without a column ``lang`` all documents are judged by script.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", quality(path)("text", lang).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and without a shuffle."""
    (name,) = fresh(docs, "verdict")
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn(name, quality(path)(docs["text"], lang)["kept"]).where(F.col(name)).drop(name)


def fitted_bands(report: DataFrame, labels: DataFrame, share: float = CLEAN_BELOW, wide: Band = Band(0, 7.0, 0.05, 0)
                 ) -> dict[str, Band]:
    """Bands by language from a ``quality_report`` with ``lang`` and ``labels`` (doc_id, quality): one aggregate.

    ``share`` of the clean documents of a language lie below its least characters per token, none
    below its least entropy; other limits are those of ``wide``. Characters are rounded, so that a
    task holds few different values.
    """
    clean = report.where(~F.col("base_failed") & (F.col("n_tokens") >= MIN_TOKENS)).join(
        labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    limits = clean.groupBy("lang").agg(
        F.percentile(F.round("chars_per_token", 3), F.lit(share)).alias("chars"), F.min("token_entropy").alias("entropy"))
    return {r["lang"]: wide._replace(min_chars=r["chars"], min_entropy=r["entropy"]) for r in limits.collect()}
