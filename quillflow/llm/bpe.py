"""Byte pair encoding and decoding with public vocabularies, split at forced boundaries.

Merges only ever make vocabulary tokens. A pair of neighbouring bytes that occurs inside no token
can therefore never be covered by one merge: a word can be cut there, the fragments encoded on
their own, and their ids concatenated. Fragments repeat far more than words do, so a bounded cache
per Python worker answers most of them; a cache that is full starts anew, which changes no result.

``WordVocabulary`` serves vocabularies that end words with a mark and drop white space,
``ByteVocabulary`` byte-level ones that keep every byte. Both agree with the tokenizers library
(add_special_tokens=False), special tokens inside texts included.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers.normalizers import NFC, Lowercase, Normalizer, Sequence

from quillflow.llm.common import per_worker, row_slices

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
# Longer fragments are merged with a heap here, the rest in batches by the tiktoken library.
BATCHED_LENGTH = 2_000
_END = "</w>"
# Mark of a word's last byte in the table of pairs.
_LAST = 256

# The split pattern of the word vocabulary, and that of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for byte in range(256):
        if byte in shown:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(extra)
            extra += 1
    return out


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to a fragment: always the pair of the lowest rank, the leftmost of equals."""
    if len(symbols) > 48:
        return _merge_long(symbols, ranks)
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(((found[0], i, found[1]) for i, pair in enumerate(zip(symbols, symbols[1:]))
                    if (found := ranks.get(pair)) is not None), default=None)
        if best is None:
            break
        symbols[best[1]:best[1] + 2] = [best[2]]
    return symbols


def _merge_long(symbols: list[int], ranks: dict) -> list[int]:
    """The same with a heap of pairs and linked neighbours, for fragments of any length."""
    n = len(symbols)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < n and (found := ranks.get((ids[i], ids[after[i]]))) is not None:
            heap.append((found[0], i, ids[i], ids[after[i]], found[1])) if not built else heapq.heappush(
                heap, (found[0], i, ids[i], ids[after[i]], found[1]))

    built = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    built = True
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        if ids[i] != left or after[i] >= n or ids[after[i]] != right:
            continue
        gone = after[i]
        ids[i], ids[gone], after[i] = new, -1, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


def _remember(cache: dict, new: dict) -> None:
    short = {k: v for k, v in new.items() if len(k) <= CACHED_LENGTH}
    if len(cache) + len(short) > CACHE_ENTRIES:
        cache.clear()
    cache.update(short)


def _parted(ids: np.ndarray, mark: int) -> list[bytes]:
    """16-bit ids of the stretches that each end in ``mark``."""
    ends, data = np.flatnonzero(ids == mark).tolist(), ids.astype("<u2").tobytes()
    return [data[2 * a:2 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]


class _Vocabulary:
    """Ids, merges and forced boundaries of one vocabulary file.

    With ``forced`` words are cut at forced boundaries, without it they are encoded whole (same
    ids; faster where words seldom have such a boundary).
    """

    def __init__(self, path: str, forced: bool = True):
        self.forced = forced
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = text
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.byte_ids = [vocab[c] for c in letters]
        self.ends = spec["model"].get("end_of_word_suffix") == _END
        self.last_ids = [vocab[c + _END] for c in letters] if self.ends else self.byte_ids
        self.inside = np.zeros((512, 512), bool)
        byte_of = {c: b for b, c in enumerate(letters)}
        for text in vocab:
            end = self.ends and text.endswith(_END) and text != _END
            codes = [byte_of[c] for c in (text[:-len(_END)] if end else text)]
            if end:
                codes[-1] += _LAST
            self.inside[codes[:-1], codes[1:]] = True
        self.special_pattern = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def cuts(self, words: list[bytes]) -> list[list[bytes]]:
        """Fragments of each word: cut wherever a pair of bytes occurs inside no token.

        A fragment that ends its word carries one more byte (a blank), as its last byte is another symbol.
        """
        data = b"".join(words)
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        if self.ends:
            codes[ends - 1] += _LAST
        cut = ~self.inside[codes[:-1], codes[1:]]
        cut[ends[:-1] - 1] = True
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(data)]
        out: list[list[bytes]] = []
        held: list[bytes] = []
        finish = iter(ends.tolist())
        end = next(finish)
        for a, b in zip(at, at[1:]):
            held.append(data[a:b] + b" " if self.ends and b == end else data[a:b])
            if b == end:
                out.append(held)
                held, end = [], next(finish, -1)
        return out

    def _merged(self, fragment: bytes) -> bytes:
        if self.ends and fragment[-1:] == b" ":
            symbols = [*(self.byte_ids[b] for b in fragment[:-2]), self.last_ids[fragment[-2]]]
        else:
            symbols = [self.byte_ids[b] for b in fragment]
        return np.array(merge(symbols, self.ranks), "<u2").tobytes()

    @functools.cached_property
    def _ranked(self) -> dict[bytes, int]:
        """The merges as ranks of byte strings; a blank stands for the end of a word.

        A blank occurs in no word of such a vocabulary, and joining it to the last byte comes
        before all other merges, so the ids are those of ``merge``.
        """
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for i, text in enumerate(self.strings):
            if text in self.special or not text:
                continue
            end = self.ends and text.endswith(_END) and text != _END
            ranks[bytes(byte_of[c] for c in (text[:-len(_END)] if end else text)) + b" " * end] = i
        return ranks

    @functools.cached_property
    def _batcher(self) -> tiktoken.Encoding:
        """Encodes fragments that are parted by line ends."""
        return tiktoken.Encoding("fragments", pat_str=r"[^\n]+|\n", mergeable_ranks=self._ranked, special_tokens={})

    def _learn_fragments(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        new, texts, names = {}, [], []
        for fragment in fragments:
            try:
                text = None if b"\n" in fragment or len(fragment) > BATCHED_LENGTH else fragment.decode()
            except UnicodeDecodeError:
                text = None
            if text is None:
                new[fragment] = self._merged(fragment)
            else:
                texts.append(text)
                names.append(fragment)
        if texts:
            texts.append("")
            ids = self._batcher.encode_to_numpy("\n".join(texts))
            new.update(zip(names, _parted(ids, self.byte_ids[10]), strict=True))
        return new

    def _pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def _words(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """The words of all pieces, and how many each piece has."""
        raise NotImplementedError

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces by forced boundaries; all their words are cut in one pass."""
        words, counts = self._words(pieces)
        fragments = self.cuts(words) if words else []
        distinct = {f for word in fragments for f in word}
        known = dict(zip(distinct, map(self.fragments.get, distinct)))
        missing = [f for f, found in known.items() if found is None]
        if missing:
            learnt = self._learn_fragments(missing)
            known.update(learnt)
            _remember(self.fragments, learnt)
        get = known.__getitem__
        ids = [get(f[0]) if len(f) == 1 else b"".join(map(get, f)) for f in fragments]
        new, at = {}, 0
        for name, count in zip(pieces, counts):
            new[name] = ids[at] if count == 1 else b"".join(ids[at:at + count])
            at += count
        return new

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, their words encoded whole."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers."""
        split: list[list[list[str] | bytes]] = []
        pieces: set[str] = set()
        for text in texts:
            parts: list[list[str] | bytes] = []
            for part in self._around_special(text):
                if part and not isinstance(part, bytes):
                    part = self._pieces(part)
                    pieces.update(part)
                if part:
                    parts.append(part)
            split.append(parts)
        # One look into the large cache per distinct piece; the texts use a small table.
        ids = dict(zip(pieces, map(self.known.get, pieces)))
        new = [p for p, found in ids.items() if found is None]
        if new:
            learnt = self._learn(new) if self.forced else self._encoded(new)
            ids.update(learnt)
            _remember(self.known, learnt)
        get = ids.__getitem__
        return [b"".join(part if isinstance(part, bytes) else b"".join(map(get, part))
                         for part in parts) for parts in split]

    def _around_special(self, text: str) -> Iterator[str | bytes]:
        if self.special_pattern is None or not any(s in text for s in self.special):
            yield text
            return
        for k, part in enumerate(self.special_pattern.split(text)):
            yield np.array([self.special[part]], "<u2").tobytes() if k % 2 else part


class WordVocabulary(_Vocabulary):
    """Words end with a mark; text is composed, lower-cased and loses its white space."""

    # White space is dropped afterwards, so it need not be folded first.
    normalizer: Normalizer = Sequence([NFC(), Lowercase()])
    pattern = regex.compile(WORD_PATTERN + r"|\n")
    # Letters up to here are composed already, and lower-cased one by one.
    simple = re.compile("[\x00-\u024f]*")

    def _pieces(self, text: str) -> list[str]:
        # Neither normal form, case nor pattern reach across a blank or a line end.
        return text.replace("\n", " ").split(" ")

    def _found(self, pieces: list[str]) -> list[str]:
        """Words of all pieces, with a line end after those of each piece."""
        text = "\n".join([*pieces, ""])
        simple = self.simple.fullmatch(text) is not None
        return self.pattern.findall(text.lower() if simple else self.normalizer.normalize_str(text))

    @functools.cached_property
    def _whole(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=self._ranked, special_tokens={})

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        ids = self._whole.encode_to_numpy(" ".join(self._found(pieces)))
        return dict(zip(pieces, _parted(ids, self.byte_ids[10]), strict=True))

    def _words(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        found = self._found(pieces)
        ends = [i for i, word in enumerate(found) if word == "\n"]
        counts = [b - a - 1 for a, b in zip([-1, *ends], ends)]
        return [w.encode() for w in found if w != "\n"], counts

    def decode(self, ids: bytes) -> str:
        """As a tokenizer without decoder does it: the vocabulary strings, with blanks between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u2").tolist()))


class ByteVocabulary(_Vocabulary):
    """Byte-level: every byte of a text is kept."""

    pattern = regex.compile(BYTE_PATTERN)
    blank = re.compile(r" (?=\S)")
    run = re.compile(r" \s")

    def _pieces(self, text: str) -> list[str]:
        """Names of pieces: a blank before a visible character always begins a new word of the pattern.

        A name without a blank in front stands for the piece with one; any other piece is named
        by itself behind a blank.
        """
        if self.run.search(text) is None:
            pieces = text.split(" ")
        else:
            pieces = self.blank.split(text)
            pieces[1:] = ["  " + p if " " in p else p for p in pieces[1:]]
        pieces[0] = " " + pieces[0]
        return pieces

    @staticmethod
    def _texts(pieces: list[str]) -> list[str]:
        return [p[1:] if p[:1] == " " else " " + p for p in pieces]

    def _words(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        found = list(map(self.pattern.findall, self._texts(pieces)))
        return [w.encode() for words in found for w in words], list(map(len, found))

    @functools.cached_property
    def _whole(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=self._ranked,
                                 special_tokens=self.special)

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        # No piece holds a special token: one parts them.
        mark, number = next(iter(self.special.items()))
        ids = self._whole.encode_to_numpy(mark.join([*self._texts(pieces), ""]), allowed_special={mark})
        return dict(zip(pieces, _parted(ids, number), strict=True))

    def decode(self, ids: bytes) -> str:
        letters = {c: b for b, c in enumerate(byte_letters())}
        out = b"".join(
            self.strings[i].encode() if self.strings[i] in self.special else
            bytes(letters[c] for c in self.strings[i]) for i in np.frombuffer(ids, "<u2").tolist())
        return out.decode("utf-8", "replace")


def word_vocabulary(path: str, forced: bool = True) -> WordVocabulary:
    return per_worker("vocabulary", ("word", path, forced), lambda: WordVocabulary(path, forced))


def byte_vocabulary(path: str, forced: bool = True) -> ByteVocabulary:
    return per_worker("vocabulary", ("byte", path, forced), lambda: ByteVocabulary(path, forced))


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text with the word vocabulary at ``path`` and decode the ids again.

    Returns doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded for
    every row of ``docs`` (doc_id, text), repeated rows included; other columns are ignored. Null
    counts as the empty text, which has no ids. No shuffle; a task holds one Arrow batch.
    """
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("decoded", pa.string())])

    def run(batches):
        vocabulary = word_vocabulary(path)
        for batch in (part for whole in batches for part in row_slices(whole)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = vocabulary.encode([t or "" for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[a:b], pa.int64()), pa.array([len(i) // 2 for i in ids], pa.int64()),
                    pa.array([widen(i) for i in ids], pa.binary()),
                    pa.array([vocabulary.decode(i) for i in ids], pa.string())], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")


def widen(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def slices(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with about ``size`` characters each."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text or "") > size:
            yield start, i
            start, total = i, 0
        total += len(text or "")
    if start < len(texts):
        yield start, len(texts)
