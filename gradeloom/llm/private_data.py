r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and words that announce an identifier. From each anchor
a small parser finds the borders of what stands there and checks it: domain labels, octets, Luhn, digit counts, IBAN remainders. Anchors
inside of what a parser has read are passed over, so that a text is read in linear time.

The base kinds are what these patterns find, leftmost and without overlap within a kind, failing matches dropped: email
``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` with parts up to 255; card
``[0-9]([\x20-]?[0-9])+`` of 13 to 19 digits that pass Luhn; phone ``\+[0-9][\x20().0-9-]+[0-9]`` of 9 to 15 digits. The method adds:

- email: one whose at-sign or dot is spelt out (``name [at] host [dot] tld``), or with letters beyond ASCII;
- ip: an IPv6 address with ``::``;
- phone: a number after ``tel:`` and the like, without a plus sign;
- url: a web address with credentials, or with a field that names a person;
- address: a house number with a street's name;
- account: what follows an identifier cue (token, password, account, passport ...), an IBAN with a right remainder, keys of known prefixes, a private key block.

An added span that lies within a base span, or overlaps an earlier added one, is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account")
SPAN = "struct<kind: int, start: int, end: int, base: boolean>"

# Public formats.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
SECRET_CUES = ("token", "password", "passwd", "passwort", "contraseña", "mot de passe", "secret", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key", "client_secret", "bearer")
NUMBER_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "driver license", "driver's license", "licence no", "tax id", "customer id", "user id", "userid", "member id", "konto", "kontonummer", "steuernummer", "cuenta", "compte", "pasaporte", "passeport", "reisepass", "dni", "nif")
NAME_CUES = ("username", "user name", "login", "benutzername", "usuario", "identifiant")
PHONE_CUES = ("tel:", "tel.:", "phone:", "telefon:", "téléphone:", "teléfono:", "mobile:", "fax:", "call me at ", "whatsapp:")
KEY_PREFIXES = ("ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "akia", "asia", "aiza", "sk-", "sk_live_", "rk_live_", "glpat-")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
PERSONAL_FIELDS = frozenset(("email", "mail", "e-mail", "user", "username", "login", "name", "phone", "tel", "token", "password", "passwd", "pwd", "session", "sessionid", "sid", "ssn", "account", "key", "apikey", "api_key"))
STREETS = ("street", "avenue", "boulevard", "lane", "straße", "strasse", "allee", "gasse")
STREETS_BEFORE = (" rue ", " calle ", " avenida ", " plaza ")
HIDDEN_AT = ("[at]", "(at)", "{at}", " at ")

_EMAIL_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ANY_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"[0-9][ ().0-9-]++")
_LOCAL_PHONE = re.compile(r"\s{0,2}(\+?[0-9(][ ().0-9/-]*+)")
_V6 = re.compile(r"[0-9A-Fa-f:]++(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:\.[0-9]{1,3}){3})?")
_V6_LEFT = frozenset("0123456789abcdefABCDEF")
_HIDDEN_DOT = re.compile(r"\s?(?:\[dot\]|\(dot\)|\{dot\}|\.| dot )\s?([A-Za-z0-9-]++)", re.I)
_HIDDEN_HOST = re.compile(r"\s?([A-Za-z0-9-]++)")
_URL = re.compile(r"[^\s<>\"'`|]++")
_TO_VALUE = re.compile(r"\s{0,2}(?:(?:no|nr|num|number|nummer|número|numéro|id|code|key|is|ist|es|est)\b\.?\s{0,2}){0,2}[#:=]{0,2}\s{0,2}", re.I)
_SIGNED = re.compile(r"[\"']?\s{0,2}(?:(?:is|ist|es|est)\b)?\s{0,2}[:=]{1,2}\s{0,2}", re.I)
_QUOTED = re.compile(r"([\"'`])([^\s\"'`]++)\1")
_SECRET = re.compile(r"[\w+/.~!@#$%^&*-]*[\w+/~-]")
_NUMBER = re.compile(r"[A-Z]{0,3}[0-9][0-9A-Z]*(?:[ -][0-9A-Z]*[0-9][0-9A-Z]*)*")
_LOGIN = re.compile(r"[\w.@-]*\w")
_KEY = re.compile(r"[A-Za-z0-9_-]++")
_BLOCK = re.compile(r"-----begin [a-z0-9 ]{0,30}private key-----", re.I)
_BLOCK_END = re.compile(r"-----end [a-z0-9 ]{0,30}private key-----", re.I)
_IBAN_REST = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_STREET_NAME = re.compile(r"[\wÀ-ÿ.'-]+(?: [\wÀ-ÿ.'-]+){0,3}")
_NAME_AND_HOUSE = re.compile(r"(?:[A-ZÀ-Þ][\wÀ-ÿ'-]*+ |de |del |la |los |las ){0,4}[A-ZÀ-Þ][\wÀ-ÿ'-]*+,? [0-9]{1,4}(?!\w)")
_HOUSE_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,4}(?: bis| ter)?,?$")
_HOUSE = re.compile(r" ?([0-9]{1,4}[a-zA-Z]?)(?!\w)")
_POSTCODE = re.compile(r",? ?[0-9]{4,5} [A-ZÀ-Þ][\wÀ-ÿ-]+")
_BEFORE_STREET = re.compile(r"(?<![\w.,-])([0-9]{1,5}[a-zA-Z]?)((?: [A-ZÀ-Þ][\wÀ-ÿ.'-]*){1,4}) ?$")


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(text: str) -> bool:
    """Right length for its country, and a remainder of 1."""
    return IBAN_LENGTHS.get(text[:2]) == len(text) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, each with what it announces."""
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    groups = (("scheme", SCHEMES), ("secret", SECRET_CUES), ("number", NUMBER_CUES), ("name", NAME_CUES), ("phone", PHONE_CUES), ("key", KEY_PREFIXES), ("street", STREETS), ("street_before", STREETS_BEFORE), ("hidden", HIDDEN_AT), ("iban", tuple(f"{c.lower()}{d}" for c in IBAN_LENGTHS for d in range(10))))
    for name, words in (("at", ("@",)), ("plus", ("+",)), ("v6", ("::",)), ("block", ("-----begin ",)), *groups):
        for w in words:
            a.add_word(w, (name, len(w)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def _lower(text: str) -> str:
    """Lower case with as many code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class _Reader:
    """The parsers of one text. ``ends`` holds, for each of them, how far it has read: an anchor before that is not read again."""

    def __init__(self, text: str):
        self.text = text
        self.base: list[Span] = []
        self.more: list[Span] = []
        self.ends = dict.fromkeys((*BASE, "url", "v6", "value", "iban", "local", "address", "block"), 0)

    def _word_start(self, i: int) -> bool:
        return not i or not (self.text[i - 1].isalnum() or self.text[i - 1] == "_")

    def _add(self, kind: str, start: int, end: int, base: bool = False) -> None:
        (self.base if base else self.more).append(Span(KINDS.index(kind), start, end, base))

    # base kinds

    def at(self, i: int, end: int) -> None:
        text, low = self.text, self.ends["email"]
        start = i
        while start > low and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        m = _DOMAIN.match(text, end) if start < i else None
        if m:
            self._add("email", start, m.end(), True)
            self.ends["email"] = m.end()
            return
        # letters beyond ASCII, as mail systems allow
        start = i
        while start > low and (text[start - 1].isalnum() or text[start - 1] in _EMAIL_LEFT):
            start -= 1
        m = _ANY_DOMAIN.match(text, end) if start < i else None
        if m and any(c.isalpha() for c in text[start:i]) and m[0].rpartition(".")[2].isalpha():
            self._add("email", start, m.end())

    def digit(self, i: int, end: int) -> None:
        text = self.text
        if i >= self.ends["ip"]:
            m = _CHAIN.match(text, i)
            self.ends["ip"] = m.end()
            if m[0].count(".") >= 3:
                parts, at = m[0].split("."), i
                for j in range(0, len(parts) - 3, 4):
                    four = parts[j : j + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in four)):
                        self._add("ip", at, at + size, True)
                    at += size + 1
        if i >= self.ends["card"]:
            m = _DIGITS.match(text, i)
            self.ends["card"] = m.end()
            if m.end() - i >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    self._add("card", i, m.end(), True)

    def plus(self, i: int, end: int) -> None:
        m = _PHONE.match(self.text, end) if i >= self.ends["phone"] else None
        if m:
            number = m[0].rstrip(" ().-")
            if len(number) >= 3:
                self.ends["phone"] = end + len(number)
                if 9 <= sum(c.isdigit() for c in number) <= 15:
                    self._add("phone", i, end + len(number), True)

    # further kinds

    def hidden(self, i: int, end: int) -> None:
        text = self.text
        at = start = i - (text[i - 1 : i] == " ")
        while start > self.ends["email"] and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        host = _HIDDEN_HOST.match(text, end) if start < at else None
        spelt, to = False, host.end() if host else 0
        while host and (m := _HIDDEN_DOT.match(text, to)):
            dot = m[0].strip().lower()
            if dot.startswith(".") and m[0] != "." + m[1]:
                break  # the end of a sentence
            spelt = spelt or "dot" in dot
            to, tld = m.end(), m[1]
        # "at" and "." alone are plain prose, so one of both must be marked
        if host and to > host.end() and (spelt or text[i:end].strip().lower() != "at") and tld.isalpha() and len(tld) >= 2:
            self._add("email", start, to)
            self.ends["email"] = max(self.ends["email"], to)

    def v6(self, i: int, end: int) -> None:
        self._v6(i)

    def _v6(self, i: int) -> None:
        text = self.text
        if i < self.ends["v6"]:
            return
        start = i
        while start > self.ends["v6"] and (text[start - 1] in _V6_LEFT or text[start - 1] == ":"):
            start -= 1
        m = _V6.match(text, start)
        self.ends["v6"] = m.end()
        s = m[0]
        groups = [g for g in s.split(":") if g]
        if len(s) <= 45 and self._word_start(start) and not text[m.end() : m.end() + 1].isalnum() and s.count("::") == 1 and ":::" not in s and 2 <= len(groups) <= 7 and all(len(g) <= 4 or "." in g for g in groups) and any(c.isdigit() for c in s):
            self._add("ip", start, m.end())

    def scheme(self, i: int, end: int) -> None:
        text = self.text
        if i < self.ends["url"] or not self._word_start(i):
            return
        m = _URL.match(text, end)
        if not m:
            return
        self.ends["url"] = m.end()
        rest = m[0].rstrip(".,;:!?)]}")
        authority = re.split(r"[/?#]", rest, maxsplit=1)[0]
        fields = {f.partition("=")[0].lower() for f in re.split(r"[?&#;]", rest)[1:] if f.partition("=")[2]}
        if text[i:end].lower() != "mailto:" and ("@" in authority or fields & PERSONAL_FIELDS):
            self._add("url", i, end + len(rest))

    def phone(self, i: int, end: int) -> None:
        m = _LOCAL_PHONE.match(self.text, end) if self._word_start(i) else None
        if m:
            number = m[1].rstrip(" ().-/")
            if 7 <= sum(c.isdigit() for c in number) <= 15:
                self._add("phone", m.start(1), m.start(1) + len(number))

    def secret(self, i: int, end: int) -> None:
        """A sign and a value, which is quoted or holds a digit."""
        text = self.text
        if i < self.ends["value"] or not self._word_start(i):
            return
        if sign := _SIGNED.match(text, end):
            if m := _QUOTED.match(text, sign.end()):
                start, to = m.span(2)
            elif m := _SECRET.match(text, sign.end()):
                start, to = m.span()
            else:
                return
            self.ends["value"] = m.end()
            if to - start >= 6 and (m.re is _QUOTED or any(c.isdigit() for c in text[start:to])):
                self._add("account", start, to)

    def number(self, i: int, end: int) -> None:
        """A cue and a number of at least five digits."""
        text = self.text
        if i < self.ends["value"] or not self._word_start(i) or text[end : end + 1].isalpha():
            return
        m = _NUMBER.match(text, _TO_VALUE.match(text, end).end())
        if m:
            self.ends["value"] = m.end()
            if sum(c.isdigit() for c in m[0]) >= 5:
                self._add("account", *m.span())

    def name(self, i: int, end: int) -> None:
        text = self.text
        if i < self.ends["value"] or not self._word_start(i):
            return
        sign = _SIGNED.match(text, end)
        m = (_QUOTED.match(text, sign.end()) or _LOGIN.match(text, sign.end())) if sign else None
        if m:
            self.ends["value"] = m.end()
            start, to = m.span(2) if m.re is _QUOTED else m.span()
            if to - start >= 3:
                self._add("account", start, to)

    def key(self, i: int, end: int) -> None:
        if i < self.ends["value"] or not self._word_start(i):
            return
        if m := _KEY.match(self.text, end):
            self.ends["value"] = m.end()
            if len(m[0]) >= 16 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                self._add("account", i, m.end())

    def block(self, i: int, end: int) -> None:
        if i >= self.ends["block"] and (m := _BLOCK.match(self.text, i)):
            last = _BLOCK_END.search(self.text, m.end())
            self.ends["block"] = last.end() if last else len(self.text)
            if last:
                self._add("account", i, last.end())

    def iban(self, i: int, end: int) -> None:
        text = self.text
        if i < self.ends["iban"] or not self._word_start(i):
            return
        if m := _IBAN_REST.match(text, i):
            # the country tells how many letters and digits belong to it
            left, to = IBAN_LENGTHS.get(text[i : i + 2], 0), i
            while left and to < m.end():
                left -= text[to] != " "
                to += 1
            self.ends["iban"] = to
            if not left and iban(text[i:to].replace(" ", "")) and not text[to : to + 1].isalnum():
                self._add("account", i, to)

    def street(self, i: int, end: int) -> None:
        """A house number before an English street, or after a German one."""
        text = self.text
        if text[end : end + 1].isalpha():
            return
        house = _HOUSE.match(text, end)
        if house and not self._word_start(i):
            start = i
            while start > max(0, i - 40) and (text[start - 1].isalpha() or text[start - 1] == "-"):
                start -= 1
            if text[start].isupper():
                self._place(start, house.end())
        elif text[i - 1 : i] == " " and (m := _BEFORE_STREET.search(text, max(0, i - 80), i)):
            self._place(m.start(), end)

    def street_before(self, i: int, end: int) -> None:
        """A house number before the word for street, or after the street's name."""
        text = self.text
        before = _HOUSE_BEFORE.search(text, max(0, i - 12), i)
        name = _STREET_NAME.match(text, end)
        parts = name[0].split(" ") if name else []
        capital = [k for k, w in enumerate(parts) if w[0].isupper()]
        if before and capital:
            self._place(before.start(), end + len(" ".join(parts[: capital[-1] + 1])))
        elif m := _NAME_AND_HOUSE.match(text, end):
            self._place(i + 1, m.end())

    def _place(self, start: int, end: int) -> None:
        if start >= self.ends["address"]:
            m = _POSTCODE.match(self.text, end)
            end = m.end() if m else end
            self.ends["address"] = end
            self._add("address", start, end)


def spans(text: str | None) -> list[Span]:
    """All spans by kind, then start. Base spans always stay."""
    if not text:
        return []
    if not _anchors:
        _anchors.append(_automaton())
    r = _Reader(text)
    for last, (name, size) in _anchors[0].iter(_lower(text)):
        getattr(r, name)(last + 1 - size, last + 1)
    if not r.more:
        return sorted(r.base)
    # within one kind base spans come first, so that the added never repeat them
    free, out = sorted(set(r.more), key=lambda s: (s.start, -s.end)), []
    base = sorted(r.base, key=lambda s: (s.start, -s.end))
    k, covered, reach = 0, 0, 0
    for s in free:
        while k < len(base) and base[k].start <= s.start:
            covered = max(covered, base[k].end)
            k += 1
        if s.end > covered and s.start >= reach:
            out.append(s)
            reach = s.end
    return sorted([*r.base, *out])


def find_private(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, masked: bool = False) -> DataFrame:
    """The ``keep`` columns (default: all) with ``spans``: an array of kind (its place in KINDS), start, end (code points, end exclusive) and base, in this order.
    With ``masked``, also ``masked``: the text with each span as ``<KIND>``; of spans that overlap, what they cover together takes the name of the first.

    One narrow stage, a text at a time: no shuffle, so ids don't matter and null or repeated ones are rows like others. A null or empty text has no spans (and is masked as it is). Long texts are read whole.
    """
    keep = list(keep if keep is not None else docs.columns)
    text = "__gl_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            found = [spans(t) for t in texts]
            flat = [s for f in found for s in f]
            offsets = [0]
            for f in found:
                offsets.append(offsets[-1] + len(f))
            cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "start", "end", "base"])
            new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)]
            if masked:
                new.append(pa.array([mask(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *new], [*keep, "__gl_spans", *(["__gl_masked"] if masked else [])])
        C.release()

    C.text_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"__gl_spans array<{SPAN}>", *(["__gl_masked string"] if masked else [])])
    out = docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, schema)
    return out.withColumnsRenamed({"__gl_spans": "spans", "__gl_masked": "masked"})


def mask(text: str | None, found: list[Span]) -> str | None:
    if not text or not found:
        return text
    out, at, kind = [], 0, None
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if kind is None or s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind].upper()}>"]
            kind = s.kind
        at = max(at, s.end)
    return "".join(out) + text[at:]


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private(C.documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return out.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
