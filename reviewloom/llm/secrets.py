"""Secrets: novelty of candidates under dictionary-primed compression, beside fixed base rules."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import prepare

BASE_KINDS = ("assign", "access", "hex")
ADDED_KIND = "novel"
#: Characters that a value right after a sensitive word has at least, and one that stands elsewhere on its line.
LEAST_DIRECT, LEAST_CHARS = 10, 16
#: A value without a digit, or one of digits that no sign leads to, needs so many, as names and numbers are shorter.
LEAST_PLAIN = 20
#: Names in code that the table's dictionary holds, those in most places.
IDENTIFIERS = 2000
#: Signs that a secret may hold.
SIGNS = "!#$%&*+-./:=?@^_~"
#: Strings of chance that a value is held against.
CHANCES = 5
#: Planted strings of each sort that set the threshold, and the precision that it keeps on them.
PLANTED, PRECISION = 60, 0.98

#: Words of code and configuration that prime the compressor beside the table's own names: what is built from them is no secret.
CODE_WORDS = """
import from return class def function const let var public private protected static void int string boolean null true false
self this new delete throw catch except finally async await yield lambda struct enum interface extends implements package
config configuration settings environment variable default value example placeholder changeme test localhost username user
password secret token api_key access_key client_id client_secret authorization bearer credential session cookie header
request response http https www com org net json yaml xml html utf-8 base64 sha256 md5 encoding content-type application
database connection host port path file name directory version license copyright documentation parameter argument
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx
"""

#: A name in code or configuration: what stands before a sign.
NAME = r"[A-Za-z_][A-Za-z0-9_.-]{2,}(?=[\x20]*[=:(])"
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LEADS = ("passw", "secret", "token", "api_key", "apikey")
#: Words that make what follows them sensitive; matched without case.
SENSITIVE = ("auth", "bearer", "credential", "private key", "private_key", "privatekey", "access_key", "accesskey", "pwd", "passphrase", "signature", "session_id", "sessionid", "client_id", "secret", "token", "password", "passwd", "api_key", "apikey", "api key")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
#: What may stand between a sensitive word and its value: quotes, a sign or a word that leads to it, a line's end.
_GAP = re.compile(r"[\"'`\])]*[\x20\t]*(?:(?:is|are|key|id|token)\b|:=|=>|->|[:=])?[\x20\t]*(?:\r?\n[\x20\t]*)?[\"'`(\[]*", re.A)
#: A value: no white space, quotes or brackets; signs at its end are no part of it.
_VALUE = re.compile(r"[^\s\"'`<>(){}\[\],;|]+")
#: '=' ends a name, so a value may begin after it, and only pads the end of a value.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % (LEAST_CHARS - 2))
_SIGN = re.compile(r"[:=>\"'`\n]")
_WORDS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted; whole matches."""
    out = []
    low = text.lower()
    if any(x in low for x in _LEADS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed size of a string, given a dictionary of names and the words around it."""

    def __init__(self, identifiers: list[str]) -> None:
        self.names = " ".join(dict.fromkeys([*CODE_WORDS.split(), *identifiers]))
        dictionary = zstandard.ZstdCompressionDict(self.names.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_checksum=False, write_content_size=False)
        self.context = (" ".join(CODE_WORDS.split()), 0)

    def of(self, words: str, value: str) -> float:
        """Bytes that the value adds to its compressed surroundings, per byte of the value. ``words`` are those of its text."""
        if words != self.context[0] or not self.context[1]:  # most texts have several candidates
            self.context = words, len(self.compressor.compress(self._around(words)))
        raw = value.encode("utf-8", "surrogatepass")
        return (len(self.compressor.compress(self._around(words) + raw)) - self.context[1]) / len(raw)

    def beside_chance(self, words: str, value: str) -> float:
        """The value's novelty over that of strings of chance with a digit, letter or sign at the same places: near 1 for a
        secret of any alphabet, less for what is made of names."""
        rng = random.Random(value)
        swap = lambda c: rng.choice(string.digits if c.isdigit() else string.ascii_uppercase if c.isupper() else string.ascii_lowercase) if c.isalnum() else rng.choice(SIGNS)
        chance = [self.of(words, "".join(map(swap, value))) for _ in range(CHANCES)]
        return self.of(words, value) * CHANCES / sum(chance)

    def _around(self, words: str) -> bytes:
        """The text's words after those of code, without which a short text has nothing to gain from."""
        return f"{CODE_WORDS}{words}\n".encode("utf-8", "surrogatepass")


def calibrated(novelty: Novelty, identifiers: list[str], seed: int = 5) -> float:
    """The least novelty that keeps PRECISION on planted strings: random ones of several alphabets among secrets; names of
    code, alone and joined, paths, placeholders and sequences among the rest."""
    rng = random.Random(seed)
    names = [x for x in dict.fromkeys([*CODE_WORDS.split(), *identifiers]) if 3 <= len(x) <= 20]
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters, string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "!#$%&*+/@^_-")
    pick = lambda n: [rng.choice(names) for _ in range(n)]
    harmless = (lambda: "_".join(pick(4)), lambda: "-".join(pick(4)), lambda: "".join(x.title() for x in pick(4)), lambda: "/" + "/".join(pick(4)), lambda: ".".join(pick(4)), lambda: rng.choice("x0*#") * rng.randint(20, 30), lambda: "abcdefghijklmnopqrstuvwxyz0123456789"[: rng.randint(20, 30)], lambda: pick(1)[0] * 5)
    scored = [(novelty.beside_chance("", "".join(rng.choice(a) for _ in range(rng.randint(20, 40)))), True) for a in alphabets for _ in range(PLANTED)]
    long = lambda make: next(x for x in iter(make, None) if len(x) >= LEAST_PLAIN)
    scored += [(novelty.beside_chance("abcdefghijklmnopqrstuvwxyz 0123456789", long(make)), False) for make in harmless for _ in range(PLANTED)]
    best, hits = 1.0, 0
    for i, (score, real) in enumerate(sorted(scored, reverse=True)):
        hits += real
        if hits >= PRECISION * (i + 1):
            best = score
    return best


def identifiers(docs: DataFrame, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The names in code that stand in most places of all texts; as many as ``most`` reach the driver."""
    names = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({NAME})"))).alias("name"))
    found = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(most)
    return [r["name"] for r in found.collect()]


def candidates(text: str) -> list[tuple[int, int]]:
    """Values after a sensitive word: the one right after it, on its line or the next, of any characters; and strings of
    letters and digits farther on its line."""
    out: list[tuple[int, int]] = []
    at = -1
    words = list(_SENSITIVE.finditer(text))
    for word in words:
        gap = _GAP.match(text, word.end())
        value = _VALUE.match(text, gap.end())
        if value and gap.end() > word.end():
            end = value.start() + len(value[0].rstrip(".:=!?") if not value[0].endswith("==") else value[0])
            whole = text[value.start() : end]
            plain = not any(c.isdigit() for c in whole) or whole.isdigit() and not _SIGN.search(gap[0])
            if len(whole) >= (LEAST_PLAIN if plain else LEAST_DIRECT) and value.start() >= at:
                out.append((value.start(), end))
                at = end
    line_end = at = -1
    for word in words:
        if word.end() <= line_end:  # an earlier word of the line has led to all that follows it
            continue
        line_end = text.find("\n", word.end())
        line_end = len(text) if line_end < 0 else line_end
        for m in _CANDIDATE.finditer(text, max(at, word.end()), line_end):
            at = max(at, m.end())
            if m.end() - m.start() >= LEAST_CHARS and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                out.append((m.start(), m.end()))
    return sorted(set(out), key=lambda c: (c[0], -c[1]))


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """Candidates that the compressor cannot foresee and no base span overlaps. The words of the whole text, each once and
    without the candidate's own, prime it."""
    found = [c for c in candidates(text) if all(c[1] <= a or b <= c[0] for a, _, b in base)]
    out, words = [], None
    for start, end in found:
        if words is None:
            words = dict.fromkeys(_WORDS.findall(text))
        value = text[start:end]
        own = set(_WORDS.findall(value))
        if novelty.beside_chance(" ".join(w for w in words if w not in own), value) >= least and (not out or start >= out[-1][2]):
            out.append((start, len(BASE_KINDS), end))
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text, as array<struct<kind, start, end, base>> sorted by start, then kind.

    Offsets are code points, ends exclusive. A null text counts as empty. Rows are judged one by one: repeated rows and
    ties change nothing, nor do further columns. Very long texts are taken whole: finding is linear in the text, and a
    candidate costs one compression of the text's distinct words. The dictionary holds the IDENTIFIERS names in code that
    stand in most places of the table, which one pass counts, and the threshold is set on planted strings with it.
    """
    prepare(docs.sparkSession)
    kinds = (*BASE_KINDS, ADDED_KIND)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = identifiers(docs, text_col)
    least = calibrated(Novelty(names), names)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(names)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base = base_spans(text) if text else []
                more = novel_spans(text, base, novelty, least) if text else []
                out.append([{"kind": kinds[k], "start": a, "end": b, "base": k < len(BASE_KINDS)} for a, k, b in sorted(base + more)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": out})

    return rows.mapInPandas(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
