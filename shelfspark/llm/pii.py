"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, scheme
marks (://), plus signs before a digit, digits, and identifier cues.  Each anchor is
expanded by a deterministic local parser into the exact span of its kind and validated.
Nothing scans a text but the automaton; a parser reads the characters round its anchor.

Spans are (kind, start, end) in code points, end exclusive.  Base kinds are email, ip, card
and phone.  Added kinds: url (a scheme with user information before the host), ssn and iban
and account (identifier cues with a validated number), secret (a key or token cue with an
assigned value of 16 or more characters, of 8 or more behind a password cue).  Cues are
found in any letter case.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, free, utf8

KINDS = ("email", "ip", "card", "phone")
MORE = ("url", "ssn", "iban", "account", "secret")

# Fixed values of the contract's patterns, and identifier cues.
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("_-+/=.")
CUES = {
    "ssn": ("ssn", "social security"),
    "iban": ("iban",),
    "account": ("account", "acct", "passport"),
    "secret": ("token", "api_key", "apikey", "secret"),
    "password": ("password", "passwd"),
}
LEAST = {"secret": 16, "password": 8}  # characters of an assigned value


def _lower(text: str) -> str:
    """A-Z to a-z alone, so that offsets stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", ("@", 1))
    out.add_word("://", ("://", 3))
    for d in sorted(DIGITS):
        out.add_word(d, ("digit", 1))
        out.add_word(f"+{d}", ("+", 2))
    for kind, cues in CUES.items():
        for cue in cues:
            out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


def _run(text: str, at: int, letters: frozenset) -> int:
    """The end of the run of letters that starts at `at`."""
    n = len(text)
    while at < n and text[at] in letters:
        at += 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address round the at-sign at `at`; nothing before `free` belongs to it."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def _numbers(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Digit runs joined by single dots from `at` on, and where the last one ends."""
    runs = []
    while True:
        end = _run(text, at, DIGITS)
        runs.append((at, end))
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
            return runs, end
        at = end + 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _card_end(text: str, at: int) -> int:
    """The end of digits with at most one space or hyphen between two of them."""
    n, end = len(text), _run(text, at, DIGITS)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = _run(text, end + 1, DIGITS)
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _phone_end(text: str, at: int) -> int | None:
    """The end of the number whose plus sign is at `at`, if it has one character at least
    between its first and its last digit."""
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def _iban(code: str) -> bool:
    code = code.upper()
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _after_cue(text: str, at: int) -> int:
    """Where a cue's value can start: behind spaces, colons, equals, hash and quotes."""
    end, n = at, min(len(text), at + 24)
    while end < n and text[end] in " :=#\"'\t":
        end += 1
    return end


def _cued(kind: str, text: str, start: int, at: int) -> tuple[str, int, int] | None:
    """The identifier that follows a cue at [start, at), validated."""
    if start and text[start - 1] in ALNUM:
        return None
    for word in (" number", " no. or", " no."):
        if _lower(text[at : at + len(word)]) == word:
            at += len(word)
            break
    value = _after_cue(text, at)
    if value == at:
        return None
    if kind == "ssn":
        part = text[value : value + 11]
        shape = len(part) == 11 and part[3] == part[6] == "-" and all(c in DIGITS for i, c in enumerate(part) if i not in (3, 6))
        ends = value + 11 >= len(text) or text[value + 11] not in ALNUM
        return ("ssn", value, value + 11) if shape and ends and part[:3] not in ("000", "666") and part[0] != "9" else None
    if kind == "iban":
        end, code = value, ""
        while end < len(text) and len(code) < 34 and (text[end] in ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM):
            code += text[end] if text[end] != " " else ""
            end += 1
            if len(code) >= 15 and _iban(code) and (end == len(text) or text[end] not in ALNUM):
                return "iban", value, end
        return None
    if kind == "account":
        end = _run(text, value, ALNUM)
        return ("account", value, end) if 6 <= sum(c in DIGITS for c in text[value:end]) and end - value <= 34 else None
    if not any(c in ":=" for c in text[at:value]):
        return None
    end = _run(text, value, VALUE)
    part = text[value:end]
    return ("secret", value, end) if end - value >= LEAST[kind] and any(c in DIGITS for c in part) else None


def _userinfo(text: str, at: int) -> tuple[int, int] | None:
    """The address round '://' at `at` when it holds user information."""
    start = at
    while start and text[start - 1] in ALNUM:
        start -= 1
    end, n = at + 3, len(text)
    while end < n and text[end] not in " \t\n\v\f\r\"'<>/?#":
        end += 1
    if start == at or "@" not in text[at + 3 : end]:
        return None
    while end < n and text[end] not in " \t\n\v\f\r\"'<>":
        end += 1
    return start, end


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text, each by kind and start."""
    base = {k: [] for k in KINDS}
    more = {k: [] for k in MORE}
    email_free = ip_free = card_free = phone_free = 0
    more_free = dict.fromkeys(MORE, 0)
    for last, (kind, size) in _automaton().iter(_lower(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_free:
                runs, ip_free = _numbers(text, at)
                for four in (runs[i : i + 4] for i in range(0, len(runs) - 3, 4)):
                    if all(_octet(text[a:b]) for a, b in four):
                        base["ip"].append((four[0][0], four[3][1]))
            if at >= card_free:
                card_free = _card_end(text, at)
                if card_free - at >= 13:
                    digits = "".join(c for c in text[at:card_free] if c in DIGITS)
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        base["card"].append((at, card_free))
        elif kind == "@":
            if at >= email_free and (found := _email(text, at, email_free)):
                base["email"].append(found)
                email_free = found[1]
        elif kind == "+":
            if at >= phone_free and (end := _phone_end(text, at)):
                phone_free = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    base["phone"].append((at, end))
        elif kind == "://":
            if at >= more_free["url"] and (found := _userinfo(text, at)):
                more["url"].append(found)
                more_free["url"] = found[1]
        elif found := _cued(kind, text, at, last + 1):
            if found[1] >= more_free[found[0]]:
                more[found[0]].append(found[1:])
                more_free[found[0]] = found[2]
    return tuple([(k, a, b) for k, found in kinds.items() for a, b in found] for kinds in (base, more))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end), base kinds first.
    Null text: empty.  Null and repeated ids stay."""
    schema = added(docs.select(id_col), "spans array<struct<kind:string,start:int,`end`:int>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            got = []
            for value in batch.column(1):
                base, more = spans(value.as_buffer().to_pybytes().decode("utf-8", "replace"))
                got.append([{"kind": k, "start": a, "end": b} for k, a, b in base + more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=[id_col, "spans"])

    return docs.select(id_col, utf8(text).alias(free([id_col], "text")[0])).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with each found span of `text` replaced by its kind's mark; null texts stay null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            got = []
            for value in batch.column(at).to_pylist():
                if value is not None:
                    base, more = spans(value)
                    out, end = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in base + more):
                        if b <= end:
                            continue
                        out += [value[end : max(a, end)], mark.format(k)]
                        end = b
                    value = "".join(out) + value[end:]
                got.append(value)
            columns = [*batch.columns]
            columns[at] = pa.array(got, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the rows of `find`: n_email .. n_phone, base_sha256 (of the base
    spans as kind:start:end, comma-joined), spans (all of them, joined likewise) and has_pii
    (any span of any kind).  No spans: zeros, the hash of the empty string, an empty string,
    false.  Null and repeated ids stay."""
    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("has_pii"))
