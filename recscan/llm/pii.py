"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

Base kinds are email, ip, card and phone. The method adds iban (mod-97) and phone_local, a number
without a country code that counts only beside a word that names a phone. Offsets are code points
with the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import small_batches

#: The order of kinds in results.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]
#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Words beside a span that raise its score.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
CONTEXT_WORDS["phone_local"] = CONTEXT_WORDS["phone"]
#: Score of a confirmed span without context; phone_local needs context to reach LEAST.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "phone_local": 0.2}
CONTEXT_BONUS, LEAST = 0.4, 0.5

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: the run's start would have matched, or failed alike
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])([A-Z]{2})[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})")
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
_PHONE_LOCAL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    """The card checksum: every second digit from the right is doubled."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The IBAN checksum: with the first four characters at the end and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ so that long runs stay cheap."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches as long as their country's numbers are, with single spaces between characters, that pass mod-97."""
    free = 0
    for m in _IBAN.finditer(text):
        left, at = _IBAN_LENGTH.get(m[1], 0) - 4, m.end()
        if left < 0 or m.start() < free:
            continue
        while left:
            skip = text[at : at + 1] == " "
            c = text[at + skip : at + skip + 1]
            if not ("A" <= c <= "Z" or "0" <= c <= "9"):
                break
            at, left = at + skip + 1, left - 1
        c = text[at : at + 1]
        if not left and not ("A" <= c <= "Z" or "0" <= c <= "9") and mod97(text[m.start() : at].replace(" ", "")):
            free = at
            yield m.start(), at


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _propose(pattern: re.Pattern, confirm: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if confirm(m.group()))


def _is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


PROPOSE: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails,
    "ip": _propose(_IP, _is_ip),
    "card": _propose(_CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _propose(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    "iban": _ibans,
    "phone_local": _propose(_PHONE_LOCAL, lambda s: True),
}
_WORDS = {k: re.compile(rf"\b(?:{'|'.join(map(re.escape, v))})\b", re.IGNORECASE) for k, v in CONTEXT_WORDS.items()}


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a whole text, by kind, then start; null counts as empty.

    Within a kind spans do not overlap. Base spans are all kept; a span the method adds is kept
    if its score reaches LEAST and it overlaps no base span.
    """
    found: list[tuple[str, int, int, float]] = []
    for kind in KINDS if text else ():
        for start, end in PROPOSE[kind](text):
            near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
            score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * bool(_WORDS[kind].search(near)))
            if kind in BASE or score >= LEAST and not any(s < end and start < e for _, s, e, _ in found):
                found.append((kind, start, end, score))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_pii(t)] for t in batch["text"].to_pylist()]
        joined = [[",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row if every or s["kind"] in BASE) for row in spans] for every in (False, True)]
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in joined[0]]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, span), pa.array(digest), pa.array(joined[1])], ["id", "pii", "base_sha256", "spans"])


def pii_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, pii (array of kind, start, end, score), base_sha256, spans.

    spans joins kind:start:end by commas; base_sha256 is the digest of the same for base kinds
    alone. A null or empty text has no span. Rows, ids (null too) and repeats stay as they are;
    other columns are not read. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema).withColumnRenamed("id", id_col)


def count_kind(pii: Column, kind: str) -> Column:
    """How many spans of a kind a row has."""
    return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")
