"""Personal data with offsets: plain identifiers, and disguised ones found after normalisation.

Plain identifiers are matched in the text itself. A text that holds a disguise (look-alike characters,
spelled digits, "at" and "dot") is then rewritten by a chain of transducers. Each keeps, for every
character it writes, the span of source characters it comes from, so what is detected in the rewritten
text is reported at its place in the source.
"""

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings
from wildtally.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails inside as well: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """Leftmost non-overlapping addresses, found from each at sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """All plain identifiers by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


class Aligned:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text, starts=None, ends=None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewrite(self, pattern: re.Pattern, write) -> "Aligned":
        """Replace each match by ``write(match)``; None leaves it."""
        return self.replace((m.start(), m.end(), write(m)) for m in pattern.finditer(self.text))

    def replace(self, edits) -> "Aligned":
        """Replace each (start, end, new), in order; all characters of ``new`` stand for the whole span."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if new is None or a == b:
                continue
            parts += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        if not parts:
            return self
        return Aligned("".join(parts) + self.text[at:], np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


# Characters that look like ASCII ones.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXIJS"))
_LOOKS |= dict(zip("οαιυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaiuABEZHIKMNOPTYX"))
_LOOKS |= {c: "-" for c in "‐‑‒–—−"} | {c: "." for c in "․。｡"} | {"﹫": "@", " ": " ", " ": " ", " ": " "}
_HIDDEN = "­​‌‍⁠﻿"
_STRANGE = re.compile("[" + "".join(map(re.escape, _LOOKS)) + _HIDDEN + "！-～]|[^\\W0-9a-zA-Z_ª-ɏ]")
_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED = "|".join(_WORDS)
_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -])?(?:{_SPELLED}|[0-9]+)(?:(?: ?[-,.] ?| )(?:{_SPELLED}|dot|point|[0-9]+))+(?!\w)")
_SPELLED_WORD = re.compile(rf"(?i)\b(?:{_SPELLED})\b")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+")
# White space before a bracket is only looked at from its start: long runs of it cost no more than others.
_BRACKETED = re.compile(r"(?i)(?:(?<!\s)\s++)?[(\[{<]\s*(at|dot)\s*[)\]}>]\s*")
# After a spelled dot any letters are a top-level domain, unless the word before it makes it a thing ("at the dot and").
_THING = "(?:the|an?|this|that|these|those|each|every|some|any|one|my|your|his|her|its|our|their|which|what|dot)(?![a-z0-9-])"
_BARE = re.compile(
    r"(?i)(?<![\w.%+-])([a-z0-9._%+-]+)(?: at | ?@ ?)((?:[a-z0-9-]+(?: dot |\.))*"
    rf"(?:[a-z0-9-]+(?: dot | \. |\.)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)|(?!{_THING})[a-z0-9-]+ dot (?!dot(?![\w-]))[a-z]{{2,63}}))(?![\w-])"
)
# A plain " at " before a plainly written domain is mostly no address ("available at github.com"). It is one
# after a local part with a mark or a digit in it, or after a word for writing to somebody.
_PLAIN_AT = re.compile(r"(?i)[^@\s]+ at [a-z0-9-]+(?:\.[a-z0-9-]+)+")
_MARKED = re.compile(r"[a-zA-Z0-9][._%+0-9]")
_WRITE_TO = re.compile(r"(?i)(?<![a-z])(?:e-?mails?|mails?|contact|write|reach|message|address)(?: address| us| me)?(?: is| to)?:? $")
_NOBODY = frozenset("us me it him her them you here there now online available directly anytime back out section page".split())
_JOINT = re.compile(r"(?i) at | ?@ ?| dot | \. ")
_JOINED = re.compile(r"(?i)[^@]+@[a-z0-9.-]+")


def _looked(m):
    c = m[0]
    if c in _HIDDEN:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


def _digits(m):
    """Runs with three spelled digits or more, as digits: "dot" is a dot, other separators go."""
    if len(_SPELLED_WORD.findall(m[0])) < 3:
        return None
    out = []
    for token in _TOKEN.findall(m[0]):
        low = token.lower()
        out.append("+" if low == "plus" else "." if low in ("dot", "point") else _WORDS.get(low, token))
    return "".join(out)


def _addressed(m) -> bool:
    """Whether a match of ``_BARE`` is to be read as an address."""
    local = m[1]
    if "@" in local or _JOINED.fullmatch(m[0]):
        return False
    if not _PLAIN_AT.fullmatch(m[0]) or _MARKED.search(local):
        return True
    return local.lower() not in _NOBODY and bool(_WRITE_TO.search(m.string, max(0, m.start() - 40), m.start()))


def normalised(text: str) -> Aligned:
    out = Aligned(text).rewrite(_STRANGE, _looked)
    out = out.rewrite(_RUN, _digits)
    out = out.rewrite(_BRACKETED, lambda m: "@" if m[1].lower() == "at" else ".")
    if not _HINT.search(out.text):
        return out
    # Only the words between the parts of an address are rewritten, so the parts keep their places.
    spans = [m.span() for m in _BARE.finditer(out.text) if _addressed(m)]
    joints = (m for a, b in spans for m in _JOINT.finditer(out.text, a, b))
    return out.replace((m.start(), m.end(), "@" if m[0].strip().lower() in ("at", "@") else ".") for m in joints)


# Every match of _BARE that is to be rewritten holds one of these.
_HINT = re.compile(r"(?i) (?:at|dot|@|\.) | @|@ ")

def disguised(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that show in the normalised text only, in source offsets."""
    form = normalised(text)
    if form.text == text:
        return []
    taken, more = list(known), []
    for kind, a, b in plain(form.text):
        span = (kind, int(form.starts[a]), int(form.ends[b - 1]))
        if not any(span[1] < y and x < span[2] for _, x, y in taken):
            taken.append(span)
            more.append(span)
    return more


_FOUND = pa.schema([("n", pa.list_(pa.int64())), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans) -> str:
    """Every span replaced by its kind in brackets; overlapping spans by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _scanned(keep_text: bool):
    def scan(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            counts, digests, told, texts = [], [], [], []
            for text in batch.column(at).to_pylist():
                base = plain(text) if text else []
                every = base + (disguised(text, base) if text else [])
                if keep_text:
                    texts.append(redacted(text, every) if every else text)
                    continue
                counts.append([sum(k == kind for k, *_ in base) for kind in KINDS])
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(every))
            if keep_text:
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            else:
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(told, pa.string())], names=_NAMES)

    return scan


_NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row of ``docs`` (doc_id, text).

    The counts and ``base_sha256`` are of the plain identifiers; ``spans`` has these and the disguised
    ones that overlap none of them, as kind:start:end in code points. A null text counts as empty,
    an empty text has no spans; rows are scanned one by one, so repeated rows, ids that are null or
    repeated, and other columns make no difference. An empty table gives no rows.
    """
    settings(docs.sparkSession)
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned(False), ddl)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind, and ``n_chars`` (if there) set anew. Null texts stay null."""
    settings(docs.sparkSession)
    out = docs.mapInArrow(_scanned(True), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
