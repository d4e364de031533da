"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over each whole text and finds anchors: at-signs, schemes, digit pairs and identifier
cues. From each anchor a small deterministic parser goes left and right to the boundaries of an e-mail address, network
address, card, phone number, web address or account, and validates it. Offsets are code points, ends exclusive.

Base kinds are email, ip, card and phone, leftmost and non-overlapping within a kind; url and account are added spans.
Defined results: a null or empty text has no spans; texts of any length are read whole; repeated rows are found alike.
"""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, documents, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")

_DIGITS = frozenset(string.digits)
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_PHONE = frozenset(string.digits + " ().-")
_URL = frozenset(string.ascii_letters + string.digits + "-._~:/?#[]@!$&'()*+,;=%")
_CODE = frozenset(string.ascii_letters + string.digits)
_LETTERS = frozenset(string.ascii_letters)

Span = tuple[int, int, str]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for d in string.digits:
        a.add_word("+" + d, ("phone", 2))
        for e in string.digits:
            a.add_word(f"{d}.{e}", ("dotted", 3))
            for gap in ("", " ", "-"):
                a.add_word(d + gap + e, ("digits", len(gap) + 2))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in (c, c.capitalize(), c.upper()):
            a.add_word(form, ("cue", len(c)))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters from at."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at at, whose local part begins at floor or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels > 1 else None


def _dotted(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The chain of digit groups joined by single dots that holds at: matches of four groups each, and its end."""
    start = at
    while start and (text[start - 1] in _DIGITS or text[start - 1] == "." and start > 1 and text[start - 2] in _DIGITS):
        start -= 1
    groups, here = [], start
    while True:
        stop = _run(text, here, _DIGITS)
        groups.append((here, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            here = stop + 1
        else:
            break
    found = []
    for g in range(0, len(groups) - 3, 4):
        four = groups[g : g + 4]
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, stop


def _digits(text: str, at: int) -> int:
    """The end of the run of digits with single spaces or hyphens between, from its first digit."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at end: past a short joint, 6 to 34 letters and digits with 4 digits or more."""
    at = end
    while at < len(text) and at - end < 12 and text[at] in " :#.=-":
        at += 1
    stop, kept = at, []
    while stop < len(text):
        if text[stop] in _CODE:
            kept.append(text[stop])
            stop += 1
        elif text[stop] in " -" and kept and stop + 1 < len(text) and text[stop + 1] in _DIGITS and kept[-1] in _DIGITS:
            stop += 1
        else:
            break
    return (at, stop) if at > end and 6 <= len(kept) <= 34 and sum(c in _DIGITS for c in kept) >= 4 else None


def find(text: str) -> list[Span]:
    """(start, end, kind), by start and then kind as in KINDS."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    spans: list[Span] = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for last, (kind, size) in _AUTOMATON[0].iter(text):
        first = last + 1 - size
        if kind == "digits":
            if first >= card_end:
                card_end = _digits(text, first)
                number = [c for c in text[first:card_end] if c in _DIGITS]
                if 14 <= len(number) <= 19 and luhn("".join(number)):
                    spans.append((first, card_end, "card"))
        elif kind == "at":
            if last >= email_end and (found := _email(text, last, email_end)):
                spans.append((*found, "email"))
                email_end = found[1]
        elif kind == "dotted":
            if last >= ip_end:
                found, ip_end = _dotted(text, last)
                spans += [(a, b, "ip") for a, b in found]
        elif kind == "phone":
            end = _run(text, first + 2, _PHONE)
            while end > first + 2 and text[end - 1] not in _DIGITS:
                end -= 1
            if end >= first + 4 and 10 <= sum(c in _DIGITS for c in text[first:end]) <= 15:
                spans.append((first, end, "phone"))
        elif kind == "scheme":
            if first >= url_end:
                end = _run(text, last + 1, _URL)
                while end > last + 1 and text[end - 1] in ".,;:!?)]'":
                    end -= 1
                if end > last + 1 and text[last + 1] in _CODE:
                    spans.append((first, end, "url"))
                    url_end = end
        elif first >= account_end and (not first or text[first - 1] not in _LETTERS) and (found := _account(text, last + 1)):
            spans.append((*found, "account"))
            account_end = found[1]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the label of the span that begins it."""
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_in(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of base spans and all spans."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in texts_of(batch)]
        counts = [pa.array([sum(s[2] == k for s in x) for x in found], pa.int64()) for k in BASE_KINDS]
        base = [hashlib.sha256(listed([s for s in x if s[2] in BASE_KINDS]).encode()).hexdigest() for x in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base), pa.array([listed(x) for x in found])], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return arrow_map(documents(docs), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text column replaced by labels; null stays null."""
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = pa.array([None if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return arrow_map(docs, make, docs.schema)
