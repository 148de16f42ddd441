"""Personal data: candidate spans judged by gradient-boosted trees, beside fixed base rules."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.boosting import BoostedTrees
from reviewloom.llm.common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the trees add, in the order in which spans that start together are listed after the base kinds.
ADDED_KINDS = ("contact", "callnumber", "national", "account")
#: The threshold keeps this precision on the calibration half of the training candidates.
PRECISION = 0.98
#: Training candidates made from templates.
FIT_ROWS = 4000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# No match can begin inside a run of digits: it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from each @ outwards: linear in the text, whatever runs of letters it has."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            upto = m.end()
        at = text.find("@", max(at + 1, upto))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: High-recall generators; they overlap on purpose. Each stands with what a text must hold for it to be worth a look. A run
#: of letters or digits is entered at its beginning only, so finding is linear however long it is.
GENERATORS = (
    ("contact", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]++(?: ?[(\[] ?(?:dot|DOT) ?[)\]] ?[A-Za-z0-9-]++| ?\. ?[A-Za-z0-9-]++)++"), re.compile(r"[(\[] ?(?:at|AT) ?[)\]]")),
    ("contact", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++"), re.compile(" (?:dot|DOT) ")),
    ("callnumber", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{2,5}(?:[ ./-][0-9]{2,5})*+(?![0-9A-Za-z])"), re.compile("[0-9]")),
    ("callnumber", re.compile(r"(?<![0-9A-Za-z+.,_-])[0-9]{7,15}(?![0-9A-Za-z])"), re.compile("[0-9]{7}")),
    ("national", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"), re.compile("[0-9]")),
    ("national", re.compile(r"(?<![0-9A-Za-z+.,_-])[A-Z]{0,2}[0-9]{6,10}[A-Z]?(?![0-9A-Za-z])"), re.compile("[0-9]{6}")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), re.compile("[A-Z]{2}[0-9]{2}")),
)
#: Words that stand before personal data, and before numbers that are none; matched without case.
CONTEXT = {
    "contact": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "callnumber": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "dial", "reach", "ring", "llama", "anruf", "appel"),
    "national": ("ssn", "social", "security", "national", "identity", "passport", "insurance", "licence", "license", "ausweis", "pasaporte", "passeport"),
    "account": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer", "payee"),
    "none": ("version", "page", "isbn", "price", "total", "order", "figure", "chapter", "score", "date", "year", "table", "serial", "part", "model", "release", "lines", "rows"),
}
#: Last parts of domain names that most addresses have.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
#: Lengths of groups in which telephone numbers are mostly written.
PHONE_GROUPS = ([3, 3, 4], [3, 4, 4], [2, 4, 4], [4, 3, 4], [4, 6], [5, 6], [3, 7], [3, 8], [2, 3, 2, 2], [2, 2, 2, 2, 2], [3, 3, 3], [4, 3, 3], [3, 2, 2, 2])
_GROUP = re.compile(r"[0-9A-Za-z]+")


def iban_valid(span: str) -> bool:
    s = re.sub(r"\s", "", span)
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and words around it, at most 48 characters before and 24 after."""
    span, before, after = text[start:end], text[max(0, start - 48) : start].lower(), text[end : end + 24].lower()
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(x) for x in _GROUP.findall(span)]
    own = CONTEXT[kind]
    near = max((before.rfind(w) for w in own), default=-1)
    return [
        float(ADDED_KINDS.index(kind)), len(span), len(digits), len(digits) / len(span), len(set(digits)), len(groups), max(groups, default=0), min(groups, default=0),
        float("(" in span), float(" " in span), float("-" in span), float("." in span), float("/" in span),
        float(near >= 0), float(len(before) - near) if near >= 0 else 99.0, float(any(w in after for w in own)), float(any(w in before for w in CONTEXT["none"])),
        float(before.rstrip().endswith((":", "#", "="))), float(before[-1:] in "$€£" and before != ""), float(iban_valid(span)) if kind == "account" else 0.0,
        float(_GROUP.findall(span)[-1].lower() in DOMAINS) if kind == "contact" else 0.0, float(span[0].isalpha()), float(groups in PHONE_GROUPS),
        float(digits[:1] in ("0", "9") if digits else 0), float(digits.startswith(("000", "666"))), float(span.endswith(" ") or after[:1] == "."),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for kind, pattern, needs in GENERATORS if needs.search(text) for m in pattern.finditer(text)]


def made_examples(rows: int = FIT_ROWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training candidates: spans of each kind in sentences that tell of them, and look-alikes in sentences that do not."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def iban(valid: bool) -> str:
        land, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = land + (f"{check:02d}" if valid else f"{(check + rng.randint(1, 90)) % 97:02d}") + body
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole

    def phone() -> str:
        groups, mark = rng.choice(PHONE_GROUPS), rng.choice([" ", "-", ".", "/"])
        parts = [number(n) for n in groups]
        if rng.random() < 0.3:
            parts[0] = f"({parts[0]})"
        return mark.join(parts) if rng.random() < 0.7 or "(" in parts[0] else f"{rng.choice('01')}{mark.join(parts)[1:]}"

    def span(kind: str, real: bool) -> str:
        """Real: as such data is written. Else what is found beside it: dates, prices, ranges, counts, sentences."""
        if kind == "contact":
            end, domain = rng.choice(DOMAINS) if real else letters(rng.randint(4, 9)), letters(rng.randint(3, 9))
            plain = f"{letters(rng.randint(3, 8))} at {domain} dot {end}"
            return plain if rng.random() < 0.5 else f"{letters(6)} {rng.choice(['(at)', '[at]', '( AT )'])} {domain} {rng.choice(['(dot)', '[dot]', '.'])} {end}"
        if kind == "callnumber":
            return phone() if real else rng.choice([f"{rng.randint(1, 9)}{number(rng.randint(6, 11))}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}", f"{number(3)}-{number(3)}", f"{number(3)} {number(3)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(2)} {number(2)}", f"{number(4)}-{number(4)}", f"{number(2)}:{number(2)}"])
        if kind == "national":
            return rng.choice([f"{rng.randint(100, 665)}-{number(2)}-{number(4)}", rng.choice(["", "C", "AB"]) + f"{rng.randint(1, 9)}{number(rng.randint(6, 8))}"])
        return iban(real)

    # What leads to it: a word of its kind, words that tell nothing, or a word that speaks against it.
    other = lambda: rng.choice([letters(rng.randint(2, 9)), f"{letters(3)} {letters(5)}", "and", "is", "on"])
    sign = lambda: rng.choice([": ", " ", " number ", " is ", " no. ", " of ", " on "])
    x, y = [], []
    for _ in range(rows):
        kind, real = rng.choice(ADDED_KINDS), rng.random() < 0.5
        told = rng.random() < 0.6
        needs_word = kind == "national"  # such numbers look like any other
        if real:
            before = rng.choice(CONTEXT[kind]) if told or needs_word else other()
            inside = span(kind, True) if kind != "callnumber" or not told or rng.random() < 0.7 else f"{rng.randint(1, 9)}{number(9)}"
        else:
            against = rng.choice(CONTEXT["none"])
            before, inside = (against, span(kind, rng.random() < 0.3)) if told else (other(), span(kind, False))
        text = f"{letters(6)} {letters(3)} {before}{sign()}{inside}{rng.choice([' ', '. ', ', '])}{letters(5)}."
        for a, b, k in candidates(text):
            x.append(features(text, a, b, k))
            y.append(float(real and k == kind and text[a:b] in (inside, inside.strip("()"))))
    return np.array(x), np.array(y)


def trained(rows: int = FIT_ROWS, precision: float = PRECISION) -> tuple[BoostedTrees, float]:
    """Trees fitted on half of the made candidates, and the threshold of the best F1 among those that keep ``precision`` on
    the other half, between the two candidates that it parts."""
    x, y = made_examples(rows)
    model = BoostedTrees().fit(x[::2], y[::2])
    p = model.probability(x[1::2])
    order = np.argsort(-p, kind="stable")
    hits, n = y[1::2][order].cumsum(), np.arange(1, len(order) + 1)
    f1 = np.where(hits >= precision * n, 2 * hits / (n + y[1::2].sum()), -1.0)
    if f1.max() < 0:
        return model, 1.0
    at = int(f1.argmax())
    after = p[order][at + 1] if at + 1 < len(order) else 0.0
    return model, float((p[order][at] + after) / 2)


def added_spans(text: str, base: list[tuple[int, int, int]], model: BoostedTrees, threshold: float) -> list[tuple[int, int, int]]:
    """Candidates over the threshold, best first, that overlap neither a base span nor a better one."""
    found = candidates(text)
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found]))
    taken, out = [(a, b) for a, _, b in base], []
    for i in sorted(np.flatnonzero(p >= threshold), key=lambda i: (-p[i], found[i][0])):
        a, b, kind = found[i]
        if all(b <= s or e <= a for s, e in taken):
            taken.append((a, b))
            out.append((a, len(BASE_KINDS) + ADDED_KINDS.index(kind), b))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Spans of personal data in every whole text, as array<struct<kind, start, end, base>> sorted by start, then kind.

    Offsets are code points, ends exclusive. A null text counts as empty. The trees are fitted on the driver on made
    candidates (FIT_ROWS sentences from templates, half of them for the threshold); rows are judged one by one, so
    repeated rows, ties and further columns change nothing. Very long texts are taken whole, in time linear in them.
    """
    prepare(docs.sparkSession)
    model, threshold = trained(precision=precision)
    kinds = BASE_KINDS + ADDED_KINDS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base = base_spans(text) if text else []
                more = added_spans(text, base, model, threshold) if text else []
                out.append([{"kind": kinds[k], "start": a, "end": b, "base": k < len(BASE_KINDS)} for a, k, b in sorted(base + more)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": out})

    return rows.mapInPandas(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
