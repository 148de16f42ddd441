"""BPE encoding and decoding that encodes chunks of content once and repairs their joins."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import prepare

#: Characters that the rolling hash covers, a power of two, and its multiplier.
WINDOW, MULTIPLIER = 16, 0x9E3779B1
#: Characters of a chunk on average.
CHUNK = 1024
#: Characters of chunks that a task keeps encoded.
KEPT_CHARS = 4_000_000
#: Words that a task keeps encoded; one more and it begins anew.
KEPT_WORDS = 500_000
#: No word that ends so many characters before the end of a text depends on what follows: more than the longest special
#: token (15) and what the splitting pattern looks ahead.
MARGIN = 16
#: Characters after a join that are encoded again at first.
AHEAD = 48
#: Characters of decoded text that a task gathers before it hands them on.
FLUSH_CHARS = 4_000_000


def rolling(codes: np.ndarray) -> np.ndarray:
    """The polynomial hash of the WINDOW code points up to each place (fewer at the beginning), by doubling."""
    h, reach, power = codes.astype(np.uint32) * np.uint32(MULTIPLIER) + np.uint32(1), 1, np.uint32(MULTIPLIER)
    while reach < WINDOW:
        h = np.concatenate([h[:reach], h[:-reach] * power + h[reach:]]) if len(h) > reach else h
        reach, power = 2 * reach, power * power
    return h


def stands_alone(char: str) -> bool:
    """Whether normalization never joins or reorders this character with what stands before it: no mark, no Hangul
    vowel or final (and nothing unassigned, which might be either)."""
    return char < "\u0300" or (unicodedata.category(char) not in ("Mn", "Mc", "Me", "Cn") and not "\u1160" <= char <= "\u11ff" and not "\ud7b0" <= char <= "\ud7ff")


#: A blank before a word: no word, contraction or special token reaches across it, and normalization joins nothing there.
_BLANK = re.compile(r"[\t-\r ](?=\S)")
#: Characters after a hit of the rolling hash in which a blank is looked for.
REACH = 64


def chunk_ends(text: str, chunk: int = CHUNK) -> list[tuple[int, bool]]:
    """(end, settled) of the chunks, and the end of the text.

    A chunk ends where the hash of the last WINDOW characters is among one of ``chunk`` values, whatever stands farther
    off: at the next blank within REACH, at which both sides are encoded as they are in the whole text (settled), else at
    once, if the next character stands alone.
    """
    with np.errstate(over="ignore"):
        h = rolling(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    out: list[tuple[int, bool]] = []
    for i in (np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint32(9) < (1 << 23) // chunk) + WINDOW).tolist():
        if out and i <= out[-1][0]:
            continue
        blank = _BLANK.search(text, i - 1, min(len(text), i + REACH))
        if blank and blank.end() < len(text) and stands_alone(text[blank.end()]):
            out.append((blank.end(), True))
        elif stands_alone(text[i]):
            out.append((i, False))
    return [*out, (len(text), True)]


class Piece:
    """A text's ids, and of each of its words (pieces between which nothing merges) the first id and the characters."""

    __slots__ = ("ends", "first", "ids", "starts")

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> None:
        self.ids = ids
        ends = np.flatnonzero(last[ids])
        self.first = np.append(0, ends[:-1] + 1) if len(ends) else ends
        self.starts, self.ends = offsets[self.first, 0], offsets[ends, 1]


#: Characters whose case, class and composition are the same in every version of Unicode, and whose lower case is one
#: character: words of these alone are looked up.
_COMMON = re.compile("[\\x00-\u012f\u0131-\u024f]*")
#: What the splitting pattern calls white space, among these.
_COMMON_SPACE = r"\t-\r \x85\xa0"


class Encoder:
    """The tokenizer of a file, its vocabulary, and the chunks and words that it encoded last.

    A chunk's encoding is its ids as little-endian unsigned 32-bit integers and its tokens with blanks between.
    """

    def __init__(self, path: str, chunk: int = CHUNK, kept_chars: int = KEPT_CHARS, kept_words: int = KEPT_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.most, self.most_words = Tokenizer.from_file(path), chunk, kept_chars, kept_words
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id ends a word.
        self.last = np.array([t.endswith("</w>") or t in self.special for t in self.vocabulary])
        self.word = self._word_pattern(path)
        self.ids_of: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.kept: OrderedDict[str, tuple[bytes, str]] = OrderedDict()
        self.chars = self.asked = self.made = 0

    @staticmethod
    def _word_pattern(path: str):
        """The file's own splitting pattern, if its steps are those that ``_common`` takes."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        steps = [x.get("type") for x in (whole["normalizer"] or {}).get("normalizers", [])]
        split = ((whole["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert"):
            return None
        return regex.compile(split["pattern"]["Regex"].replace(r"\s", _COMMON_SPACE))

    def piece(self, text: str) -> tuple[bytes, str]:
        """The encoding of a chunk, made once for all documents of the task that share it, as long as it is kept."""
        self.asked += 1
        found = self.kept.get(text)
        if found is not None:
            self.kept.move_to_end(text)
            return found
        self.made += 1
        found = self._common(text)
        if found is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes(), self._tokens(ids)
        self.kept[text] = found
        self.chars += len(text)
        while self.chars > self.most:
            self.chars -= len(self.kept.popitem(last=False)[0])
        return found

    def _common(self, text: str) -> tuple[bytes, str] | None:
        """The encoding of a chunk of common characters without special tokens, word by word; None of others.

        Nothing merges across words, so each is encoded by the library when it is first met.
        """
        if self.word is None or not _COMMON.fullmatch(text) or any(s in text for s in self.special):
            return None
        words = self.word.findall(text.lower())
        new = [w for w in dict.fromkeys(words) if w not in self.ids_of]
        if new:
            if len(self.ids_of) + len(new) > self.most_words:
                self.ids_of.clear()
                self.shown.clear()
                new = list(dict.fromkeys(words))
            self._keep(new)
        return b"".join(map(self.ids_of.__getitem__, words)), " ".join(map(self.shown.__getitem__, words))

    def _keep(self, words: list[str]) -> None:
        """Encode words with blanks between them, in one call; ids that end a word tell them apart."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        raw, ends = np.array(ids, "<u4").tobytes(), (np.flatnonzero(self.last[ids]) + 1).tolist()
        tokens = list(map(self.vocabulary.__getitem__, ids))
        start = 0
        for word, end in zip(words, ends, strict=True):
            self.ids_of[word], self.shown[word] = raw[4 * start : 4 * end], " ".join(tokens[start:end])
            start = end

    def _tokens(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.__getitem__, ids))

    def decode(self, ids: np.ndarray) -> str:
        """What a tokenizer without a decoder gives: its tokens, special ones too, with blanks between."""
        return self._tokens(ids.tolist())

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids, decoded) that the tokenizer gives the whole text: chunks between settled ends, or what ``_repaired`` makes
        of chunks whose ends are not."""
        if not text:
            return b"", ""
        out, at, open_ends = [], 0, []
        for end, settled in chunk_ends(text, self.chunk):
            if not settled:
                open_ends.append(end)
            elif open_ends:
                ids = self._repaired(text[at:end], [e - at for e in (*open_ends, end)])
                out.append((ids.astype("<u4").tobytes(), self.decode(ids)))
                at, open_ends = end, []
            else:
                out.append(self.piece(text[at:end]))
                at = end
        return b"".join(ids for ids, _ in out), " ".join(shown for _, shown in out if shown)

    def _placed(self, text: str) -> Piece:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Piece(np.array(e.ids, np.uint32), np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2), self.last)

    def _repaired(self, text: str, ends: list[int]) -> np.ndarray:
        """The ids of a text cut at these ends, wherever they fall.

        Before each join, ``out`` and the words of ``piece`` from ``word`` on are the ids of text[:a]. What lies around
        the join is encoded again from the start s of a word that no text after a can change. If that agrees with the
        next chunk on the start of a word, out of reach of the window's end, both go on alike from there and the rest of
        the chunk is taken as it is; else the window grows, at last to the end of the chunk, which needs no agreement.
        """
        out: list[np.ndarray] = []
        piece, base, word, begin, a = self._placed(text[: ends[0]]), 0, 0, 0, ends[0]  # the piece is of text[base:a]; its words count from begin on
        for b in ends[1:]:
            after = self._placed(text[a:b])
            k = int(piece.ends.searchsorted(a - base - MARGIN, "right")) - 1
            while k > word and not self._clean(text, piece, k, base):
                k -= 1
            s = base + int(piece.starts[k]) if k > word else begin
            if k > word:
                out.append(piece.ids[piece.first[word] : piece.first[k]])
            width = AHEAD
            while True:
                e = min(b, a + width)
                window = self._placed(text[s:e])
                met = None if e == b else self._meeting(text, window, s, e, after, a)
                if met or e == b:
                    break
                width *= 4
            if met:
                i, j = met
                out.append(window.ids[: window.first[i]])
                piece, base, word, begin = after, a, j, a + int(after.starts[j])
            else:
                piece, base, word, begin = window, s, 0, s
            a = b
        if word < len(piece.first):
            out.append(piece.ids[piece.first[word] :])
        return np.concatenate(out) if out else np.array([], np.uint32)

    @staticmethod
    def _clean(text: str, piece: Piece, k: int, base: int) -> bool:
        """Whether the word begins at a character of its own that stands alone."""
        return (k == 0 or piece.starts[k] >= piece.ends[k - 1]) and stands_alone(text[base + int(piece.starts[k])])

    def _meeting(self, text: str, window: Piece, s: int, e: int, after: Piece, a: int) -> tuple[int, int] | None:
        """The first words of the window and of the chunk that begin at the same place."""
        for i in range(int(window.starts.searchsorted(a - s)), int(window.ends.searchsorted(e - s - MARGIN, "right"))):
            q = s + int(window.starts[i])
            j = int(after.starts.searchsorted(q - a))
            if j < len(after.starts) and a + int(after.starts[j]) == q and self._clean(text, window, i, s) and self._clean(text, after, j, a):
                return i, j
        return None


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, chunk: int = CHUNK) -> Encoder:
    if (path, chunk) not in _encoders:
        _encoders[path, chunk] = Encoder(path, chunk)
    return _encoders[path, chunk]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, ids (little-endian unsigned 32-bit integers), decoded.

    The tokenizer is one of word-end BPE without a decoder; special tokens in a text are found as its library does, none
    is added. Texts are cut into chunks by a rolling hash, so texts that share a passage share its chunks. Each task
    encodes a chunk once and keeps the last KEPT_CHARS characters of chunks, and within chunks each word once; joins that
    no blank settles are encoded again until they agree (``Encoder._repaired``), so the ids are those of the whole text,
    whatever the chunks. Null and empty texts have no ids
    and decode to an empty text. Repeated rows and ties are encoded row by row. Very long texts are as any other: work is
    linear in their chunks, unless a text has no place where words begin, which is then encoded from its start. Only
    doc_id and text are read, so further columns of any name do no harm. An empty table gives no rows. Nothing is
    shuffled or broadcast, so a lost task is simply run again.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer, chunk)
        for pdf in batches:
            out, chars = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                out.append((doc, *own.encode(text or "")))
                chars += len(out[-1][-1])
                if chars > FLUSH_CHARS:
                    yield pd.DataFrame(out, columns=["doc_id", "ids", "decoded"])
                    out, chars = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "ids", "decoded"])

    return rows.mapInPandas(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
