"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digit pairs, plus signs before digits and
identifier cues. Around each anchor a deterministic parser of linear cost expands the match to its boundaries and
validates it. An anchor inside a span of its own kind starts no other one. The parsers for emails, IP addresses, cards and phones give exactly the leftmost non-overlapping
matches of their base patterns, as every match lies in one run of the pattern's characters that holds an anchor.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import table
from . import textvec as V

#: The base kinds, then those that the method adds, in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_intl", "url_login", "iban", "ssn", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[\w.-]+[^\s\"'<>]*")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?))?[\s:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?))?[\s:#=]{1,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9-])")
_ASSIGNED = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}")
_SECRET = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}(?:\"([^\s\"]{8,})\"|'([^\s']{8,})'|([^\s\"',;]{8,}))")

_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "token": "secret", "password": "secret", "passwd": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret"}


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors by the parser that they start."""
    out = ahocorasick.Automaton()
    words = {"@": "@", "://": "://"}
    for a in "0123456789":
        words[f"+{a}"] = "phone"
        for b in "0123456789":
            words |= {f"{a}{b}": "card", f"{a} {b}": "card", f"{a}-{b}": "card", f"{a}.{b}": "ip"}
    for cue, kind in _CUES.items():
        words |= {form: kind for form in (cue, cue.upper(), cue.capitalize())}
    for word, kind in words.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _back(text: str, at: int, floor: int, allowed: frozenset[str]) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


_DIGIT_DOT = frozenset("0123456789.")
_DIGIT_SEP = frozenset("0123456789 -")


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points, sorted by start and then by kind."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (what, length) in automaton().iter(text):
        at = last + 1 - length
        if what == "@":
            start = _back(text, at, done["email"], _LOCAL)
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                wide = start
                spans.append(("email", start, m.end()))
                done["email"] = m.end()
            else:
                wide = at
            # A local part or domain with other letters than ASCII.
            while wide > 0 and (text[wide - 1] in _LOCAL or text[wide - 1].isalnum()):
                wide -= 1
            m = _WIDE_DOMAIN.match(text, at + 1)
            if wide < at and m and not text[wide : m.end()].isascii() and done["email_intl"] <= wide:
                spans.append(("email_intl", wide, m.end()))
                done["email_intl"] = m.end()
        elif what == "ip":
            if at >= done["ip"]:
                start = _back(text, at, done["ip"], _DIGIT_DOT)
                stop = at + 1
                for run in _DOTTED.finditer(text, start):
                    if run.start() > at + 2 and text[run.start() - 1] != ".":
                        break
                    stop = run.end()
                    parts, p = run.group().split("."), run.start()
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        size = sum(map(len, four)) + 3
                        if all(map(_octet, four)):
                            spans.append(("ip", p, p + size))
                        p += size + 1
                    if text[stop : stop + 1] != ".":
                        break
                done["ip"] = max(stop, at + 1)
        elif what == "card":
            if at >= done["card"]:
                m = _CHAIN.match(text, _back(text, at, done["card"], frozenset("0123456789")))
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        elif what == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append(("phone", m.start(), m.end()))
        elif what == "://":
            m = _LOGIN.match(text, at + 3) if at >= done["url_login"] and at and text[at - 1].isalnum() else None
            if m:
                start = at
                while start and text[start - 1].isalnum() and at - start < 16:
                    start -= 1
                stop = m.end()
                while text[stop - 1] in ".,;:!?)]}":
                    stop -= 1
                spans.append(("url_login", start, stop))
                done["url_login"] = m.end()
        elif at == 0 or not text[at - 1].isalnum():
            # A value that begins inside the last secret is not read again, so that a text of cues costs no more.
            if what == "secret" and (m := _ASSIGNED.match(text, last + 1)) and m.end() + 1 < done["secret"]:
                continue
            pattern = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "secret": _SECRET}[what]
            m = pattern.match(text, last + 1)
            if m:
                group = m.lastindex
                start, stop = m.span(group)
                if what != "iban" or _iban_ok(m.group(group)):
                    if done[what] <= start:
                        spans.append((what, start, stop))
                        done[what] = stop
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _iban_ok(text: str) -> bool:
    """The check of ISO 13616: the rearranged account number is 1 modulo 97."""
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in V.slices(batches):
        found = [find(text) if text else [] for text in batch.column("text").to_pylist()]
        out = {name: batch.column(name) for name in batch.schema.names}
        out["spans"] = pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in found], kind)
        yield pa.RecordBatch.from_pydict(out)


def find_pii(docs: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add `spans` to each document: array of (kind, start, stop), in code points, by start and then kind.

    Edge cases: null and empty texts have no spans; failing matches (an IP part above 255, a card without a valid
    check digit) are dropped and not tried again at other places; rows are judged one by one, so repeated rows and
    null doc_ids need no care; cost is linear in the text, however long its runs; an empty table gives an empty result;
    other columns play no part, and a carried column named `spans` gives way to the result.
    """
    docs = V.chosen(docs, "doc_id", "text", carry, ("spans",))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{fields}, spans array<struct<kind:string,start:int,stop:int>>")


def redact(docs: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; where spans overlap, the first stays."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for kind, start, stop in find(text) if text else ():
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                        at = stop
                texts.append(text if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())})

    docs = V.chosen(docs, "doc_id", "text", carry, ())
    return docs.mapInArrow(replace, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts of the base kinds, the digest of their spans, and all spans."""
    out = find_pii(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
