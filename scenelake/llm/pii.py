"""Personal data found by anchors and local parsers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import sliced, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Identifier cues and the kind of number that may follow; fixed values.
CUES = {
    "ssn": "ssn", "social security": "ssn",
    "iban": "iban",
    "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account",
    "passport": "passport", "reisepass": "passport", "passeport": "passport", "pasaporte": "passport",
}
SCHEMES = ("mailto:", "tel:", "sip:", "http://", "https://", "ftp://")
SPAN = "struct<kind:string,start:int,end:int,value:string>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER = re.compile(r"(?: ?(?:no|nr|number|num|id))?[.:#= ]{1,4}", re.A | re.I)
_NUMBERS = {
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "account": re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])"),
    "passport": re.compile(r"[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])"),
}
#: user and password of a link have at most 256 characters each, so a run of schemes is read in linear time
_LINK = re.compile(r"[^\s/@:?#]{1,256}(?::[^\s/@]{0,256})?@[A-Za-z0-9.-]+")
_TEL = re.compile(r"[+0-9][0-9().-]{5,18}")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class PiiSpec:
    #: kinds beside the four base ones: numbers after a cue, and links that carry an account
    cues: bool = True
    links: bool = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_valid(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def automaton(spec: PiiSpec = PiiSpec()):
    """Aho-Corasick over at-signs, plus signs, digits, and schemes and cues in lower, upper and title case."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", ""))
    a.add_word("+", ("plus", ""))
    for d in "0123456789":
        a.add_word(d, ("digit", ""))
    for cue, kind in CUES.items() if spec.cues else ():
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            a.add_word(form, ("cue", kind))
    for s in SCHEMES if spec.links else ():
        for form in {s, s.upper(), s.capitalize()}:
            a.add_word(form, ("scheme", s))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of ``text`` by start, in code points.

    Each anchor is expanded on the spot by the parser of its kind. For the base kinds this is the
    leftmost non-overlapping reading: after a match that fails its check, reading goes on behind it.
    """
    spans: list[tuple[str, int, int]] = []
    email_to = ip_to = card_to = phone_to = 0
    digit_at = -2
    for end, (what, extra) in anchors.iter(text):
        if what == "digit":
            run_start, digit_at = digit_at + 1 != end, end
            if not run_start:
                continue
            if end >= ip_to and (m := _IP.match(text, end)):
                ip_to = m.end()
                if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.groups()):
                    spans.append(("ip", end, ip_to))
            if end >= card_to and (m := _CARD.match(text, end)):
                card_to = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", end, card_to))
        elif what == "at":
            start = end
            while start > email_to and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                email_to = m.end()
                spans.append(("email", start, email_to))
        elif what == "plus":
            if end >= phone_to and (m := _PHONE.match(text, end)):
                phone_to = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", end, phone_to))
        elif what == "cue":
            if (m := _AFTER.match(text, end + 1)) and (n := _NUMBERS[extra].match(text, m.end())):
                if {"iban": iban_valid, "ssn": ssn_valid}.get(extra, bool)(n[0]):
                    spans.append((extra, n.start(), n.end()))
        elif extra in ("mailto:", "sip:") or "//" in extra:
            if m := _LINK.match(text, end + 1):
                spans.append(("link", end + 1 - len(extra), m.end()))
        elif m := _TEL.match(text, end + 1):
            spans.append(("link", end + 1 - len(extra), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[1], order.get(s[0], 9), s[0], s[2]))


def scan(docs: DataFrame, spec: PiiSpec = PiiSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, value) of each whole text.

    One row per input row, repeated rows alike; an empty table gives none. A null or empty text has no span; texts of any
    length are read once, in one piece. Only the two columns named are read, whatever the others are called.
    """

    def run(batches):
        anchors = automaton(spec)
        for b in sliced(batches, 512):
            ids, texts = b.column(0), b.column(1).to_pylist()
            found = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find(t, anchors)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(
                        found,
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
                    )
                ],
                ["doc_id", "spans"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, and their number."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", label)).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
