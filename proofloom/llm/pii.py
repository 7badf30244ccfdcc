"""Operator 4: personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass over a text; local
parsers then expand each anchor to the whole item and validate it. Base kinds are those of the contract: email, ip
(parts at most 255), card (14 to 19 digits, Luhn) and phone (10 to 15 digits); an item that fails its check is consumed
and dropped. The method adds `iban` (mod 97), `account` (8 to 17 digits after an account cue) and `userinfo` (name and
password before an at-sign in an address with a scheme).

Null and empty texts give no spans; very long ones are scanned whole. Rows are independent, so repeated rows repeat their
result, and null doc_ids are kept. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import rows_mapper, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "userinfo")
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"(?:[ \t]*(?:number|no|nr|num)\.?)?[ \t]*[:#=]?[ \t]*([0-9]{8,17})(?![0-9])", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(r"[ \t]*[:=]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%-]+:[^\s/@:]+(?=@)")
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word in ("@", "+", *"0123456789", "://", *(f(c) for c in CUES for f in (str.lower, str.upper, str.title))):
            a.add_word(word, word)
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item, by start, then kind in the order of KINDS."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = 0
    for last, word in automaton().iter(text):
        first = word[0]
        if "0" <= first <= "9":
            if last < run_end:  # items begin at the first digit of a run, and end at the last one of a run
                continue
            run_end = _DIGITS.match(text, last).end()
            if last >= ip_end and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append((last, ip_end, 1))
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, card_end, 2))
        elif first == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, email_end, 0))
        elif first == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((last, phone_end, 3))
        elif first == ":":
            if m := _USERINFO.match(text, last + 1):
                out.append((m.start(), m.end(), 6))
        elif m := _IBAN.match(text, last + 1):
            if iban_valid(m[1]):
                out.append((m.start(1), m.end(1), 4))
        elif m := _NUMBER.match(text, last + 1):
            out.append((m.start(1), m.end(1), 5))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _work(columns: dict[str, list]) -> Iterator[dict]:
    for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
        spans = find(text or "")
        base = [s for s in spans if s[2] in BASE]
        yield {"doc_id": doc_id, **{f"n_{k}": sum(s[2] == k for s in base) for k in BASE}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(rows_mapper(_work, SCHEMA), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, mask: str = "<{}>") -> str | None:
    """The text with each item, or run of overlapping items, replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, kind in find(text or ""):
        if a >= at:
            out += [text[at:a], mask.format(kind)]
        at = max(at, b)
    return None if text is None else "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
