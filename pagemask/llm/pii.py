"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, '://' and other schemes, '+', digits, account cues). At each anchor a
deterministic parser expands to the boundaries of an email, phone number, network address, card or account number and
validates it. Every parser reads a stretch once, so the work is linear in the text.

Kinds: email, ip, card, phone; and, beyond these, address (mailto: or tel: links, and addresses with a user name in them,
such as ftp://ann:pw@host) and account (IBAN with a valid checksum, or 6 to 17 digits after an account cue).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemask.llm.common import SPANS, SPANS_ARROW, batches_of, id_and_text, span_digest, texts

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "address", "account"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_AUTHORITY = re.compile(r"[A-Za-z0-9._%+~-]+(?::[^\s@/]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
_MAILTO = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TEL = re.compile(r"\+?[0-9][0-9().-]{6,18}[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_AFTER_CUE = re.compile(r"(?:[ .:#=-]|\b(?:no|nr|number|num|is|id)\b){0,12}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_CUES = ["account", "acct", "iban", "routing number"]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors; the payload says which parser to start."""
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for w, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("mailto:", "mailto"), ("tel:", "tel")):
        a.add_word(w, kind)
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, "cue")
    a.make_automaton()
    return a


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, sorted by start and then kind; spans of one kind don't overlap."""
    found: list[tuple[int, int, int]] = []
    at: dict[str, int] = dict.fromkeys([*KINDS, "run"], 0)  # where each kind's next match may start

    def keep(kind: str, start: int, end: int) -> None:
        if start >= at[kind]:
            found.append((start, KINDS.index(kind), end))
            at[kind] = end

    for last, what in automaton.iter(text):
        if what == "digit":
            if last < at["run"]:
                continue
            run_end = at["run"] = _RUN.match(text, last).end()
            if last >= at["ip"] and (m := _IP.match(text, last)):
                at["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((last, 1, m.end()))
            if last >= at["card"] and (m := _CARD.match(text, last)):
                at["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((last, 2, m.end()))
            if run_end - last >= 2 and last >= 2 and text[last - 2 : last].isalpha() and text[last - 2 : last].isascii() and text[last - 2 : last].isupper() and not text[last - 3 : last - 2].isalnum():
                if m := _IBAN.match(text, last - 2):
                    end = m.end()
                    while end - last > 12 and not _iban(text[last - 2 : end]):  # following words may look like more groups
                        end = text.rfind(" ", last, end)
                    if end - last > 12:
                        keep("account", last - 2, end)
        elif what == "at":
            start = last
            while start > at["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                keep("email", start, m.end())
        elif what == "plus":
            if last >= at["phone"] and (m := _PHONE.match(text, last)):
                at["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((last, 3, m.end()))
        elif what == "scheme":
            start = last - 2
            while start > at["address"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < last - 2 and text[start].isalpha() and (m := _AUTHORITY.match(text, last + 1)):
                keep("address", start, m.end())
        elif what in ("mailto", "tel"):
            if m := (_MAILTO if what == "mailto" else _TEL).match(text, last + 1):
                keep("address", last - len(what), m.end())
        else:
            gap = _AFTER_CUE.match(text, last + 1)
            if gap.end() > gap.start() and (m := _ACCOUNT.match(text, gap.end())):
                keep("account", m.start(), m.end())
    found.sort()
    return [(KINDS[k], s, e) for s, k, e in found]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind,start,end,text>>, one row per input row.

    Null and empty texts give an empty array; a null id stays null; repeated rows each give a row; other columns are not read.
    """

    def scan(batches):
        auto = anchors()
        rows = ((i, [{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in find_spans(t, auto)]) for i, t in texts(batches))
        yield from batches_of({"doc_id": pa.int64(), "spans": SPANS_ARROW}, rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return span_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
