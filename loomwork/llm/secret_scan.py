"""Secrets in texts: fixed patterns, and assignments read by a small lexer of source and configuration syntax.

The lexer cuts a text into tokens (strings with prefixes, escapes and triple quotes, names, operators, lines with their
indents). A pass over the tokens reads name-literal pairs: assignments with or without types, subscripts, keys of JSON
and YAML at any depth, list items, INI lines, and XML elements and attributes. It joins literals that are added up and carries constants
to the names they are assigned to. Calls, subscripts and other expressions are no literals. Each literal is scored by how
sensitive the names are that it reaches.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Parts of names, a hyphen where a separator may stand, with how sensitive a name is that has them.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pass-phrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "api-key": 1.0,
    "access-key": 1.0, "private-key": 1.0, "signing-key": 0.9, "encryption-key": 0.9, "credential": 0.8, "authorization": 0.7,
    "bearer": 0.7, "connection-string": 0.8,
}
# Keys that say nothing of their own, so that the key above them counts.
GENERIC = {"value", "default", "data", "content", "text", "string", "val", "raw", "plain", "current", "literal"}
# What stands where a secret would, without being one: words of a literal, whole literals, and what is filled in later.
PLACEHOLDERS = {"example", "changeme", "placeholder", "your", "dummy", "redacted"}
EMPTY_VALUES = {"none", "null", "true", "false", "undefined"}
_FILLED_IN = re.compile(r"\$\{[^}]*\}|\{\{.*?\}\}|<[^<>]*>")
_BLANKED = re.compile(r"[xX*._\-]*(?:[xX]{4}|\*{4})[xX*._\-]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_SENSITIVE = {re.compile(part.replace("-", r"[_\-.\x20]?"), re.IGNORECASE): w for part, w in SENSITIVE.items()}
_ANY_SENSITIVE = re.compile("|".join(p.pattern for p in _SENSITIVE), re.IGNORECASE)

# what may begin a string: a prefix and quotes, with the backslashes of a string around it. It begins no word.
_OPENING = r"""(?<![A-Za-z0-9\\])\\*[bBrRfFuU]{0,2}(?:"{3}|'{3}|"|')"""
_OTHERS = (
    r"""(?P<line>\n[\x20\t]*)|(?P<mark>\#+|//+|/\*+|\*+/)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z0-9_$]+)*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|::|->|[=:+,;(){}\[\]<>|&?*])|(?P<other>\S)"""
)
_TOKEN = re.compile(rf"(?P<string>{_OPENING})|{_OTHERS}")
_NO_STRING = re.compile(_OTHERS)
# up to the quotes that end a string, from behind those that open it
_ENDS = {
    '"""': re.compile(r'(?:[^\\"]|\\[\s\S]|"(?!""))*+"""'), "'''": re.compile(r"(?:[^\\']|\\[\s\S]|'(?!''))*+'''"),
    '"': re.compile(r'(?:[^"\\\n]|\\[^\n])*+"'), "'": re.compile(r"(?:[^'\\\n]|\\[^\n])*+'"),
}
_ESCAPED = {quote: re.compile(r"(\\*)" + quote) for quote in ('"', "'")}
_QUOTES = re.compile(r"""\\*[A-Za-z]{0,2}("{3}|'{3}|"|'|`)""")
_BACKTICKS = re.compile(r"`[^`]*`")
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>]+""")
_SCHEME = re.compile(r"(?:bearer|basic|token)[\x20\t]+", re.IGNORECASE)
# names, with a short number at most behind each: what a variable is called
_REFERENCE = re.compile(r"[A-Za-z_$]+[0-9]{0,2}(?:[.:\-]+[A-Za-z_$]+[0-9]{0,2})*\Z")
_KEY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\-\x20]*\Z")
_TYPE_OPS = frozenset("[]<>|&?*,")
_ELEMENT = re.compile(r"""<([A-Za-z_][\w:.\-]*)((?:\s+[\w:.\-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*/?>([^<]*)""")
_ATTRIBUTE = re.compile(r"""([\w:.\-]+)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""")

Found = tuple[str, list[tuple[int, int]]]


def sensitivity(name: str) -> float:
    return max((w for part, w in _SENSITIVE.items() if part.search(name)), default=0.0)


def _mixed(literal: str) -> bool:
    return bool(re.search("[A-Za-z]", literal) and re.search("[0-9]", literal))


def is_placeholder(literal: str) -> bool:
    words = [w.lower() for w in _WORD.findall(literal)]
    return literal.lower() in EMPTY_VALUES or bool(_BLANKED.fullmatch(literal)) or not PLACEHOLDERS.isdisjoint(words) or ("change", "me") in zip(words, words[1:])


def literal_score(name: str, literal: str, least: int = 8) -> float:
    """0 to 1: the name's sensitivity times how far the literal looks drawn at random.

    What is filled in later (`${NAME}`, `{{name}}`, `<name>`) doesn't count. Of a literal with white space the best word with letters
    and digits counts, since prose stands under such names too; under a passphrase's name it counts as a whole.
    """
    literal = _FILLED_IN.sub("", literal).strip()
    if len(literal) < least or is_placeholder(literal):
        return 0.0
    words = literal.split()
    if len(words) > 1 and "passphrase" not in re.sub(r"[^a-z]", "", name.lower()):
        return max((literal_score(name, w, least) for w in words if re.search("[A-Za-z]", w) and re.search("[0-9]", w)), default=0.0)
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return sensitivity(name) * min(1.0, entropy / math.log2(max(n, 2)) * (0.4 + 0.3 * kinds))


def tokens_of(text: str, first: int, last: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each token of a stretch of text, in time that grows with its length."""
    out, at, strings = [], first, Strings(text, first, last)
    while m := _TOKEN.search(text, at, last):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind == "string":
            end = strings.end(at, m[0])
            if end is None:
                m = _NO_STRING.match(text, a, last)
                kind, end = m.lastgroup, m.end()
            at = end
        out.append((kind, a, at))
    return out


class Strings:
    """Where strings end: at their quotes without a backslash, on their line if the quotes are single.

    One in a string around it, so that its quotes have backslashes, ends at a quote with as many or fewer. One that only an escaped quote ends is
    taken up to that quote. Whether a quote is escaped does not depend on where its string began, so where a search found no
    end, later ones up to there are spared.
    """

    def __init__(self, text: str, first: int, last: int) -> None:
        self.text, self.last = text, last
        self.barren = dict.fromkeys(_ENDS, first)
        self.deeper = dict.fromkeys(_ENDS, (first, 0))  # up to where all quotes have more backslashes than so many

    def end(self, at: int, opening: str) -> int | None:
        quote = opening.lstrip("\\bBrRfFuU")
        n = len(opening) - len(opening.lstrip("\\"))
        if len(quote) == 3:
            end = self.plain(at, quote)
            if end is not None:
                return end
            at, quote = at - 2, quote[0]
        end = self.inner(at, quote, n) if n % 2 else self.plain(at, quote)
        if end is None:
            found = self.text.find(quote, at, self.line(at))
            end = found + 1 if found >= 0 else None
        return end

    def line(self, at: int) -> int:
        end = self.text.find("\n", at, self.last)
        return self.last if end < 0 else end

    def plain(self, at: int, quote: str) -> int | None:
        if at < self.barren[quote]:
            return None
        if m := _ENDS[quote].match(self.text, at, self.last):
            return m.end()
        self.barren[quote] = self.line(at) if len(quote) == 1 else self.last
        return None

    def inner(self, at: int, quote: str, n: int) -> int | None:
        until, most = self.deeper[quote]
        if at < until and n <= most:
            return None
        line = self.line(at)
        for m in _ESCAPED[quote].finditer(self.text, at, line):
            if len(m[1]) <= n:
                return m.end()
        self.deeper[quote] = line, n
        return None


class Reader:
    """One pass over a text's tokens; pairs() gives (name, literal, the places of its parts) in order."""

    def __init__(self, text: str, first: int, last: int, constants: dict[str, Found], depth: int = 0) -> None:
        self.text, self.last, self.depth, self.constants = text, last, depth, constants
        self.tokens = tokens_of(text, first, last)
        self.at = 0
        self.closers: list[tuple[str, str | None]] = []  # open brackets and the name whose value they hold
        self.indents: list[tuple[int, str]] = []  # keys above, of YAML, with their indents
        self.indent, self.fresh = 0, True

    def token(self, ahead: int = 0) -> tuple[str | None, int, int]:
        return self.tokens[self.at + ahead] if 0 <= self.at + ahead < len(self.tokens) else (None, self.last, self.last)

    def op(self, ahead: int = 0) -> str:
        kind, a, b = self.token(ahead)
        return self.text[a:b] if kind == "op" else ""

    def inner(self, a: int, b: int) -> tuple[int, int]:
        """Between the quotes, and between the backslashes that belong to them: an odd number before the last one."""
        quote = _QUOTES.match(self.text, a)
        start, end = quote.end(), b - len(quote[1])
        if self.text[end - 1 : end] == "\\":
            n = end - start - len(self.text[start:end].rstrip("\\"))
            end -= n if n % 2 else 0
        return start, end

    def above(self) -> str:
        return (self.closers[-1][1] if self.closers else self.indents[-1][1] if self.indents else None) or ""

    def pairs(self) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        while self.at < len(self.tokens):
            kind, a, b = self.token()
            if kind == "line":
                yield from self.line(b, b - a - 1)
            elif kind == "op":
                if self.text[a:b] == "," and self.closers and self.closers[-1][0] == "call":
                    self.closers[-1] = ("default", self.closers[-1][1])
                self.bracket(self.text[a:b], None)
                self.at += 1
            elif kind in ("string", "name"):
                yield from self.target(kind, a, b)
            else:
                self.at += 1
            self.fresh = self.fresh and kind in ("line", "mark")

    def line(self, end: int, indent: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        self.at += 1
        self.fresh, self.indent = True, indent
        if self.closers or self.token()[0] in ("line", None):
            return
        item = self.text.startswith("- ", end)
        while self.indents and self.indents[-1][0] >= indent + item:
            self.indents.pop()
        if item:
            self.indent = indent + 2
            self.at += 1  # the hyphen
            if self.indents and self.target_op()[0] is None:
                yield from self.value(self.indents[-1][1], "", False)

    def bracket(self, op: str, name: str | None) -> None:
        if op in ("{", "[", "("):
            self.closers.append((op, name))
        elif op in ("}", "]", ")") and self.closers:
            self.closers.pop()

    def target_op(self) -> tuple[int | None, bool]:
        """How many tokens ahead the value stands, if a name and an assignment stand here, and whether a colon assigns it."""
        kind, a, b = self.token()
        if kind not in ("string", "name"):
            return None, False
        ahead = 1
        if kind == "string" and self.op(1) == "]" and self.op(-1) == "[":
            ahead = 2
        if self.op(ahead) == "?" and self.op(ahead + 1) == ":":
            ahead += 1
        if self.op(ahead) in ("=", ":=", "=>"):
            return ahead + 1, False
        if self.op(ahead) == ":":
            typed = self.annotation(ahead + 1)
            if typed is not None:
                return typed, False
            if self.text[self.token(ahead)[2] : self.token(ahead)[2] + 1] not in ("/", ":"):
                return ahead + 1, True
        return None, False

    def annotation(self, ahead: int) -> int | None:
        """How many tokens ahead the value behind `type =` stands: blanks around the sign, or a string behind it."""
        for k in count(ahead):  # ends at the next colon at the latest, so that no token is read for many
            kind, a, b = self.token(k)
            if kind == "op" and self.text[a:b] == "=":
                spaced = self.text[a - 1 : a].isspace() and self.text[b : b + 1].isspace()
                return k + 1 if k > ahead and (spaced or self.token(k + 1)[0] == "string") else None
            if kind != "name" and not (kind == "op" and self.text[a:b] in _TYPE_OPS) and not (kind == "other" and self.text[a:b] == "'"):
                return None
        return None

    def target(self, kind: str, a: int, b: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        ahead, colon = self.target_op()
        inner = self.inner(a, b) if kind == "string" else (a, b)
        name = self.text[slice(*inner)]
        if ahead is None or not _KEY.match(name):
            held = self.closers[-1] if self.closers else ("", None)
            if kind == "string" and (held[0] in ("[", "(") and held[1] or held[0] == "default" and _mixed(name)):
                yield from self.value(held[1], "", False)
            else:
                if kind == "string":
                    yield from self.within(*inner)
                self.at += 1
                if kind == "name" and self.op() in ("(", "["):
                    self.bracket(self.op(), None)
                    self.at += 1
            return
        first = self.fresh
        if self.op(1) == "]" and self.closers:
            self.closers.pop()
        above, _, generic = self.above().rpartition(".")
        above = above if above and generic.lower() in GENERIC else self.above()  # of generic names below each other the last
        full = f"{above}.{name}" if name.lower() in GENERIC and above else name
        self.at += ahead
        self.constants.pop(name, None)  # until it is known what is assigned now
        if colon and self.token()[0] in ("line", None):
            if first and not self.closers:
                self.indents.append((self.indent, full))
            return
        yield from self.value(full, name, colon)

    def value(self, name: str, constant: str, colon: bool) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        if self.op() in ("{", "[", "("):
            self.bracket(self.op(), name)
            self.at += 1
            return
        parts: list[Found] = []
        while True:
            found = self.operand(bool(parts))
            if found:
                parts.append(found)
            while parts and self.token()[0] == "line" and self.closers and self.closers[-1][0] == "(":
                self.at += 1
            if self.op() == "+" and parts:
                self.at += 1
            elif not (found and self.token()[0] == "string" and not self.is_key()):
                break
        if parts:
            whole = "".join(p[0] for p in parts), [place for p in parts for place in p[1]]
            if constant:
                self.constants[constant] = whole
            yield name, *whole
            for _, places in parts:
                for place in places:
                    yield from self.within(*place)
        elif self.op() == "(":  # of a call only literals behind its first argument count: what it gives where nothing is set
            self.closers.append(("call", name))
            self.at += 1

    def is_key(self) -> bool:
        return self.target_op()[0] is not None

    def operand(self, added: bool) -> Found | None:
        """A literal, or the literal that a name stands for; the place moves behind it. None for other expressions."""
        kind, a, b = self.token()
        text = self.text
        if kind == "string":
            self.at += 1
            inner = self.inner(a, b)
            return text[slice(*inner)], [inner]
        if kind in (None, "line") or (kind == "op" and text[a:b] not in ("=", "*", "&", "+", "|", "?")):
            return None
        if text[a : a + 1] == "`":
            m = _BACKTICKS.match(text, a, self.last)
            self.skip(m.end() if m else a + 1)
            return (m[0][1:-1], [(a + 1, m.end() - 1)]) if m else None
        scheme = _SCHEME.match(text, a, self.last)
        m = _BARE.match(text, scheme.end() if scheme else a, self.last)
        if not m:
            self.skip(a + 1)
            return None
        bare = m[0].rstrip(".!?")
        if bare in self.constants:
            self.skip(m.end())
            return self.constants[bare]
        if "+" in bare[1:] and bare.split("+")[0] in self.constants:
            bare = bare.split("+")[0]
            self.skip(m.start() + len(bare))
            return self.constants[bare]
        reads = text[m.end() : m.end() + 1] in ("(", "[") or bool(_REFERENCE.match(bare))
        self.skip(b if reads else m.end())  # what stands in a call is read like anything else
        return None if reads or added or not _mixed(bare) else (bare, [(m.start(), m.start() + len(bare))])

    def skip(self, place: int) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at][1] < place:
            self.at += 1

    def within(self, a: int, b: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        """The pairs inside of a string, as in connection strings and quoted lines."""
        if self.depth < 6 and b - a > 4 and _ANY_SENSITIVE.search(self.text, a, b) and re.compile("[=:]").search(self.text, a, b):
            yield from Reader(self.text, a, b, self.constants, self.depth + 1).pairs()


def element_pairs(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """The pairs of XML: elements with texts, and elements whose attributes are a key and a value."""
    for m in _ELEMENT.finditer(text):
        values = {x[1].lower(): x for x in _ATTRIBUTE.finditer(text, *m.span(2))}
        key = next((values[k] for k in ("key", "name", "id") if k in values), None)
        name = f"{m[1]}.{key[2] or key[3] or ''}" if key else m[1]
        body = m[3].strip()
        if body:
            at = text.index(body, m.start(3))
            yield name, body, [(at, at + len(body))]
        if "value" in values:
            x = values["value"]
            g = 2 if x[2] is not None else 3
            yield name, x[g], [x.span(g)]


def lexed_pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(name, literal, places of its parts): each literal for the name it is assigned to and each it is carried on to."""
    pairs = list(Reader(text, 0, len(text), {}).pairs())
    return pairs + list(element_pairs(text)) if "<" in text else pairs


def find_secrets(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret value) by start, then kind as listed in KINDS."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    # without a sensitive name no literal scores, whatever it is carried on to
    if ("=" in text or ":" in text or "</" in text) and _ANY_SENSITIVE.search(text):
        base = sorted((f[3], f[4]) for f in found)
        reach, ends = 0, []
        for _, b in base:
            reach = max(reach, b)
            ends.append(reach)
        new = set()
        for name, literal, places in lexed_pairs(text):
            if literal_score(name, literal) >= threshold:
                for a, b in places:
                    k = bisect_right(base, (a, len(text)))
                    if b > a and not (k and ends[k - 1] >= b):
                        new.add((a, b))
        outer = 0
        for a, b in sorted(new, key=lambda x: (x[0], -x[1])):
            if b > outer:  # else inside of another
                found.append(("literal", a, b, a, b))
                outer = b
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def scan_secrets(docs: DataFrame, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_literal, base_sha256, spans, values), a row for each document.

    spans joins kind:start:end (code points, end exclusive) of all finds; base_sha256 is the hash of the same without those
    that only the lexer finds. A null or empty text has none, and the hash of the empty string. Repeated rows give repeated results.
    """

    def start():
        def work(text: str) -> list[tuple]:
            found = find_secrets(text, threshold)
            n = Counter(f[0] for f in found)
            spans = [f"{k}:{a}:{b}" for k, a, b, _, _ in found]
            base = ",".join(s for s, f in zip(spans, found) if f[0] != "literal")
            values = [{"start": c, "end": d} for _, _, _, c, d in found]
            return [(n["assign"], n["access"], n["hex"], n["literal"], hashlib.sha256(base.encode()).hexdigest(), ",".join(spans), values)]

        return work

    fields = "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string, values array<struct<start: int, `end`: int>>"
    return map_texts(docs, id_col, text_col, fields, start)


def redact(text: str, mark: str = "[REDACTED]", threshold: float = 0.6) -> str:
    """The text with each secret value replaced; values that overlap are replaced as one."""
    out, done = [], 0
    for a, b in sorted((f[3], f[4]) for f in find_secrets(text, threshold)):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with secret values replaced in text_col, and length_col, if there, made to fit. Null texts stay null; all rows stay."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, mark))

    out = docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
