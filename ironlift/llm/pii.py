"""Personal data by anchor expansion: an automaton finds at-signs, schemes, digit pairs and cues; parsers expand and validate around them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tune

#: Kinds in their order. The first four are the base; the method adds the others.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_PHONE = frozenset(" ().0123456789-")
_SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
_CUES = ("IBAN", "iban", "account", "Account", "ACCOUNT", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta")
_SECRETS = ("token", "Token", "TOKEN", "secret", "Secret", "SECRET", "api_key", "apikey", "apiKey", "API_KEY", "api-key", "access_key", "ACCESS_KEY", "private_key", "PRIVATE_KEY", "password", "Password", "PASSWORD", "passwd")
#: What may stand between a cue and a value: the rest of the name, a quote, an equals sign or colon, a quote.
_ASSIGNED = re.compile(r"""[A-Za-z0-9_-]{0,24}["']?\s{0,3}(?:=|:|=>|:=)\s{0,3}(["']?)""")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=~-]+")
#: Least characters of a secret, in quotes or bare.
_LEAST_QUOTED, _LEAST_BARE = 12, 16
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"[^A-Za-z0-9]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: ?(?:no\.?|number|nr\.?|n°|#))?\s{0,2}[:=#]?\s{0,2}([0-9]{6,18})(?![0-9])")
_URL = re.compile(r"[^\s/@:]+:[^\s/@]+@[^\s]+")

_automaton = None


def automaton():
    """Anchors: at-signs, + and a digit, two digits with at most one separator between, schemes and cues. Built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        for d in "0123456789":
            a.add_word(f"+{d}", ("phone", 2))
            for e in "0123456789":
                a.add_word(f"{d}.{e}", ("ip", 3))
                for sep in ("", " ", "-"):
                    a.add_word(f"{d}{sep}{e}", ("card", 2 + len(sep)))
        for s in _SCHEMES:
            a.add_word(s, ("url", len(s)))
        for c in _CUES:
            a.add_word(c, ("iban" if c.lower() == "iban" else "account", len(c)))
        for c in _SECRETS:
            a.add_word(c, ("secret", len(c)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _ip(text: str, at: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """All of the dotted run around a digit and a dot: its groups of four numbers from the left, and its end."""
    start = at
    while start > floor and text[start - 1] in _DIGIT:
        start -= 1
    parts, i, n = [], start, len(text)
    while True:
        j = i
        while j < n and text[j] in _DIGIT:
            j += 1
        parts.append((i, j))
        if j + 1 < n and text[j] == "." and text[j + 1] in _DIGIT:
            i = j + 1
        else:
            break
    out = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
            out.append((four[0][0], four[3][1]))
    return out, j


def _card(text: str, at: int) -> tuple[int, int]:
    """The whole run of digits, single spaces or dashes between, that begins at at."""
    i, n = at + 1, len(text)
    while i < n:
        if text[i] in _DIGIT:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _DIGIT:
            i += 2
        else:
            break
    return at, i


def _phone(text: str, at: int) -> tuple[int, int] | None:
    i, n = at + 2, len(text)
    while i < n and text[i] in _PHONE:
        i += 1
    while i > at + 2 and text[i - 1] not in _DIGIT:
        i -= 1
    return (at, i) if i >= at + 4 else None


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _secret(text: str, end: int) -> tuple[int, int] | None:
    """The value assigned after a cue that ends at end: letters and digits both, long enough, and its closing quote where one opened."""
    m = _ASSIGNED.match(text, end)
    v = m and _VALUE.match(text, m.end())
    if not v:
        return None
    a, b = v.span()
    if m[1]:
        sound = b - a >= _LEAST_QUOTED and text[b : b + 1] == m[1]
    else:
        while b > a and text[b - 1] in ".=-":  # a sentence's end is no part of the value
            b -= 1
        sound = b - a >= _LEAST_BARE
    value = text[a:b]
    return (a, b) if sound and any(c in _DIGIT for c in value) and any(c.isalpha() for c in value) else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, in code points, by start and then by kind in the order of KINDS."""
    if not text:
        return []
    done = dict.fromkeys(KINDS, 0)  # each kind's matches do not overlap: where the last one ended
    out: list[tuple[str, int, int]] = []
    for end, (kind, size) in automaton().iter(text):
        at = end - size + 1
        if at < done[kind]:
            continue
        if kind == "email":
            if span := _email(text, at, done[kind]):
                out.append((kind, *span))
                done[kind] = span[1]
        elif kind == "ip":
            spans, done[kind] = _ip(text, at, done[kind])
            out += [(kind, *s) for s in spans]
        elif kind == "card":
            a, b = _card(text, at)
            done[kind] = b
            digits = [c for c in text[a:b] if c in _DIGIT] if b - a <= 64 else []
            if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                out.append((kind, a, b))
        elif kind == "phone":
            if span := _phone(text, at):
                done[kind] = span[1]
                if 10 <= sum(c in _DIGIT for c in text[span[0] : span[1]]) <= 15:
                    out.append((kind, *span))
        elif kind == "url":
            if m := _URL.match(text, end + 1):
                out.append((kind, at, m.end()))
                done[kind] = m.end()
        elif kind == "iban":
            m = _IBAN.match(text, end + 1)
            while m:
                value = m[1].rstrip()
                sized = next((value[:k] for k in range(len(value), 14, -1) if value[k - 1] != " " and iban_valid(value[:k])), "")
                if sized:
                    out.append((kind, m.start(1), m.start(1) + len(sized)))
                    done[kind] = m.start(1) + len(sized)
                break
        elif kind == "secret":
            if span := _secret(text, end + 1):
                out.append((kind, *span))
                done[kind] = span[1]
        elif m := _ACCOUNT.match(text, end + 1):
            out.append((kind, *m.span(1)))
            done[kind] = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


@F.arrow_udf(SPANS)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in texts], _ARROW)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, and each run of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([None if (x := t.as_py()) is None else redacted(x, s) if (s := find(x)) else x for t in texts], pa.string())


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: (kind, start, end) in code points, end exclusive.

    email, ip, card and phone are what their regular expressions find from the left without overlap and what
    then passes validation; a failing match is dropped and not tried again from within. url (with a user and
    password), iban (checksum holds), account (digits after a cue) and secret (a value of letters and digits assigned
    to a name with a cue such as token, key or password) come on top. Very long texts are searched whole. A null or empty text has
    none; repeated rows each get their own; an empty table gives an empty one; a clashing column spans stays and the new one gets underscores.
    """
    tune(docs.sparkSession)
    (name,) = fresh(docs, "spans")
    return docs.withColumn(name, _find(F.col(text)))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text replaced by its kind; null stays null, and texts without spans stay as they are.

    Overlapping spans are one, of the first's kind; very long texts are searched whole, repeated rows each get their
    own, an empty table gives an empty one, and no column is added.
    """
    tune(docs.sparkSession)
    return docs.withColumn(text, _redact(F.col(text)))
