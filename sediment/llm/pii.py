"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, URL schemes and cue words
of identifiers, in a copy of the text whose ASCII letters are lowered. From each anchor a local parser walks to the span's boundaries and validates it; text
without an anchor is passed over at the automaton's speed, and no parser walks over a character more than a
fixed number of times. Base kinds (email, ip, card, phone) equal a leftmost non-overlapping search for their
patterns; the cues add url, secret, iban, ssn and account.

A null text counts as empty and has no spans; repeated rows give repeated rows; spans of different kinds may
overlap and come by start, then kind; a text of any length is read whole; an empty table gives an empty
result; extra columns are left aside, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import documents, small_batches, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "iban", "ssn", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = DIGITS | LETTERS | {"-"}
LOCAL = LABEL | set("._%+")
DIALLED = DIGITS | set(" ().-")
JOINT = frozenset(" -")
URL_STOP = frozenset(" \t\n\r\v\f\"'<>`{}|\\^")
URL_TRAIL = frozenset(".,;:!?)]")
VALUE = DIGITS | LETTERS | set("_-./+=~")
SEPARATORS = frozenset(" \t\"'`:=#")
#: Words that may stand between a cue and its value.
MARKS = ("number", "no.", "nr.")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://")
CUES = {
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access_key", "private_key"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def run_end(text: str, at: int, chars: frozenset | set) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int, int]:
    """From an at-sign: (start, end, where the search goes on); start -1 if there is none. floor: end of the email before."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return -1, -1, floor
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_end(text, end + 1, LABEL)
        dots += 1
    return (start, end, end) if dots else (-1, -1, floor)


def ip(text: str, at: int) -> tuple[int, int, int]:
    """From the first digit of a run: four runs joined by single dots, none above 255."""
    first = end = run_end(text, at, DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        start, end = end + 1, run_end(text, end + 1, DIGITS)
        parts.append(text[start:end])
    if len(parts) < 4:
        return -1, -1, first
    return (at if all(map(at_most_255, parts)) else -1), end, end


def card(text: str, at: int) -> tuple[int, int, int]:
    """From a digit: digits with single blanks or hyphens between, 14 to 19 of them under Luhn's sum."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in JOINT and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "") if end - at >= 14 else ""
    return (at if 14 <= len(digits) <= 19 and luhn(digits) else -1), end, end


def phone(text: str, at: int) -> tuple[int, int, int]:
    """From a plus sign: a digit, dialling marks, and the last digit among them."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return -1, -1, at + 1
    end = run_end(text, at + 2, DIALLED)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return -1, -1, at + 1
    digits = sum(c in DIGITS for c in text[at:end])
    return (at if 10 <= digits <= 15 else -1), end, end


def url(text: str, at: int, scheme: str) -> tuple[int, int, int]:
    """From a scheme: everything up to a stop, without closing punctuation; it needs a host."""
    host, end = at + len(scheme), at + len(scheme)
    while end < len(text) and text[end] not in URL_STOP:
        end += 1
    goes_on = end
    while end > host and text[end - 1] in URL_TRAIL:
        end -= 1
    return (at if end > host and (text[host] in LABEL or text[host] == "[") else -1), end, goes_on


def lowered(text: str) -> str:
    """ASCII letters in lower case; every character keeps its place."""
    return text.encode().lower().decode()


def value_start(text: str, at: int, need: bool) -> int:
    """Behind a cue: blanks, quotes, separators and marks such as `no.`; -1 if a separator is needed and none stands there."""
    seen = False
    while True:
        while at < len(text) and text[at] in SEPARATORS:
            seen |= text[at] in ":="
            at += 1
        mark = "" if need and seen else next((m for m in MARKS if text[at : at + len(m)].lower() == m and text[at + len(m) : at + len(m) + 1] not in LETTERS), "")
        if not mark:
            return at if seen or not need else -1
        at += len(mark)


def secret(text: str, at: int) -> tuple[int, int, int]:
    """Behind a cue and a separator: a value of eight characters or more that holds a digit."""
    start = value_start(text, at, True)
    if start < 0:
        return -1, -1, at
    end = run_end(text, start, VALUE)
    while end > start and text[end - 1] in ".-/":
        end -= 1
    good = end - start >= 8 and any(c in DIGITS for c in text[start:end])
    return (start if good else -1), end, max(end, at)


def iban(text: str, at: int) -> tuple[int, int, int]:
    """Behind a cue: two letters, two digits, 11 to 30 more in groups, under the mod-97 check."""
    start = value_start(text, at, False)
    letters, end, best = [], start, -1
    while end < len(text) and len(letters) < 34:
        if text[end] in DIGITS or text[end] in LETTERS:
            letters.append(text[end].upper())
            end += 1
            if len(letters) >= 15 and letters[0].isalpha() and letters[1].isalpha() and letters[2].isdigit() and letters[3].isdigit():
                if int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1 and (end == len(text) or text[end] not in DIGITS and text[end] not in LETTERS):
                    best = end
        elif text[end] == " " and letters:
            end += 1
        else:
            break
    return (start, best, best) if best > 0 else (-1, -1, at)


def ssn(text: str, at: int) -> tuple[int, int, int]:
    """Behind a cue: three, two and four digits with hyphens or blanks between, none of the three all zero."""
    start = value_start(text, at, False)
    body = text[start : start + 11]
    good = len(body) == 11 and body[3] in JOINT and body[6] in JOINT and all(c in DIGITS for c in body[:3] + body[4:6] + body[7:])
    good = good and body[:3] not in ("000", "666") and body[4:6] != "00" and body[7:] != "0000" and (start + 11 == len(text) or text[start + 11] not in DIGITS)
    return (start, start + 11, start + 11) if good else (-1, -1, at)


def account(text: str, at: int) -> tuple[int, int, int]:
    """Behind a cue: 6 to 17 digits."""
    start = value_start(text, at, False)
    end = run_end(text, start, DIGITS)
    return (start, end, end) if 6 <= end - start <= 17 and (end == len(text) or text[end] not in LETTERS) else (-1, -1, at)


AFTER_CUE = {"secret": secret, "iban": iban, "ssn": ssn, "account": account}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", "@"))
    found.add_word("+", ("phone", "+"))
    for d in DIGITS:
        found.add_word(d, ("digit", d))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", scheme))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, cue))
    found.make_automaton()
    return found


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    floor, out = dict.fromkeys(KINDS, 0), []

    def note(kind: str, found: tuple[int, int, int]) -> None:
        start, end, floor[kind] = found
        if start >= 0:
            out.append((start, end, kind))

    for last, (kind, form) in automaton().iter(lowered(text)):
        at = last - len(form) + 1
        if kind == "digit":
            if at >= floor["ip"]:
                note("ip", ip(text, at))
            if at >= floor["card"]:
                note("card", card(text, at))
        elif at < floor[kind]:
            continue
        elif kind == "email":
            note(kind, email(text, at, floor[kind]))
        elif kind == "phone":
            note(kind, phone(text, at))
        elif kind == "url":
            note(kind, url(text, at, form))
        else:
            note(kind, AFTER_CUE[kind](text, last + 1))
    out.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return out


def find_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans array<struct<kind, start, end>>): one pass, no shuffle."""
    small_batches(df.sparkSession)
    source = df.select(F.col(f"`{key}`"), text_or_empty(f"`{text}`").alias("__text"))
    kind = df.schema[key].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], names=[key, "spans"])

    return source.mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span's kind in its place; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
