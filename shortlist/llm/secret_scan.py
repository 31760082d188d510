"""Secret scans by patterns and by assignment-aware lexing.

Three fixed patterns give the base spans: ``assign`` (a telling name with a
value of 12 or more characters), ``access`` (access key ids) and ``hex`` (runs
of hexadecimal digits). The method adds spans of kind ``literal``: it lexes the
text as source code or configuration into names, assignment operators and
literals, reads ``name = expression`` pairs (``=``, ``:=``, ``=>``, ``:``;
quoted or dotted names; ``+`` between parts, strings side by side, arguments
of a call), carries constants from one name to the next in the order of the
text, and scores every literal that reaches a name by how telling the name is
and how random the literal looks. A bare name is no literal, unless it is a
constant's or only a value can stand where it stands. The span is
that of the literal where it stands, also when only another name passes it on.
An unquoted value on the line of its operator reaches to white space, a comma
or the next ``;name=`` or ``&name=``, unless it is a call, an index or a sum of
names known before. A name holds across a type annotation
(``password: str = ...``, ``var password string = ...``) and across an index;
a quoted index (``config["password"] = ...``) is a name too.

Positions are code points, ends exclusive. Base patterns match left to right
without overlap, each kind for itself; a match that is too short is dropped
after it has used up its characters. Whole texts are scanned. Values share the
constants in them, and a literal is scored at most once for each score that a
name can have, so the work is linear in the text.

Defined results: a null text counts as empty and has no spans; a null or
repeated doc_id and repeated rows give a row each; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shortlist.llm.common import col

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: A token of source code or configuration: comment mark, string, name,
#: operator, bare value; names may have dots and dashes inside.
LEXEME = re.compile(
    r"""(?P<string>(?<![\w$])(?:[rRbBuUfF]{1,2}|[@$])?"""
    r"""(?:\"{3}[^"][\s\S]*?\"{3}|'{3}[^'][\s\S]*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<op>:=|=>|->|==+|!=+|<=|>=|[?!]:|\?=|[=:+])"""
    r"""|(?P<end>[;,\n}\])])"""
    r"""|(?P<other>\S)""", re.ASCII)
ASSIGNMENTS = {"=", ":=", "=>", ":", "?:", "!:", "?="}


def nested(a: str, z: str, no: str = "") -> str:
    """A pattern of brackets with up to three pairs inside each other on a line."""
    free = rf"[^\n\{a}\{z}{no}]"
    inner = rf"\{a}{free}*+\{z}"
    for _ in range(2):
        inner = rf"\{a}(?:{free}|{inner})*+\{z}"
    return inner


#: Where an unquoted value begins after its operator (a comment's mark after a
#: space is none), and what ends it.
BARE = re.compile(r"""[ \t]*+(?!(?<=[ \t])\#)(?=[^\s,\[({"'`])""")
STOP = re.compile(r"[\s,]|[;&](?=[A-Za-z_][\w .-]*=)|\Z")
#: Source code in its place: a call, an index or members.
CODE = re.compile(
    r"[A-Za-z_$][\w$]*(?:(?:\??\.|->|::)[A-Za-z_$][\w$]*)*"
    rf"(?:(?:{nested('(', ')')}|{nested('[', ']')})(?=[\s;,.)\]}}\[(]|\Z)|\([ \t]*(?=\n|\Z)|(?=[;)}}]*(?:[\s,]|\Z)))",
    re.ASCII)
#: A type between ``:`` and ``=`` with a value on its line, and whether that is quoted.
_TYPE = (r"(?:&(?:'\w+[ \t]+)?(?:mut[ \t]+)?)?(?=[A-Za-z_*?(\[])"
         rf"(?:[\w.*?!]|::|{nested('[', ']')}|{nested('<', '>', '=;')}|{nested('(', ')')})++")
TYPE = re.compile(rf"""[ \t]*{_TYPE}(?:[ \t]*[|&][ \t]*{_TYPE})*"""
                  r"""(?:[ \t]*(?==[ \t]*(?:[rRbBuUfF]{1,2}|[@$])?(?P<quote>["'`]))|[ \t]+(?==[ \t]+\S))""", re.ASCII)
DECLARATIONS = {"var", "const", "let", "val", "final"}
QUOTE = re.compile("[\"'`]")
WHITE = re.compile(r"\s")
OPENERS = {")": "(", "]": "[", "}": "{", ">": "<"}

#: How telling a part of a name is, 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9,
    "bearer": 0.8, "auth": 0.6, "signature": 0.6, "key": 0.5, "pass": 0.6, "salt": 0.5, "pin": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|x{3,}|\*{3,}|change_?me|your[_-].*|example.*|"
                         r"none|null|true|false|password|secret|token|undefined)$")
#: Least product of the name's and the literal's score.
MIN_SCORE = 0.4
MIN_LITERAL = 8
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_score(name: str) -> float:
    """The most telling part of a name; parts are its snake, kebab, dotted or
    camel case words, alone or two together."""
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)


def literal_score(value: str) -> float:
    """How random a literal looks, 0 to 1: its bits by letter frequency (32
    are enough) and its kinds of characters; less with white space, none for
    short ones and placeholders."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    # More characters never have fewer bits, so the first ones often do.
    bits = 0.0
    for part in (value[:256], value):
        bits = max(bits, -sum(c * math.log2(c / len(part)) for c in Counter(part).values()))
        if bits >= 32:
            break
    spread = min(1.0, bits / 32)
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]"))
    return spread * (0.55 + 0.15 * kinds) * (0.5 if re.search(r"\s", value) else 1.0)


class Bare:
    """Unquoted values of a text, asked for from left to right. What holds for
    a run of characters is found once, so that all of them together take time
    linear in the text."""

    def __init__(self, text: str):
        self.text = text
        self.end = self.op = self.quote = self.counted = 0
        self.open: Counter[str] = Counter()

    def span(self, at: int, constants: dict) -> tuple[int, int, bool] | None:
        """(start, end, whether an operator is in it) of the unquoted value
        after ``at``, if there is one of more than a token and not code."""
        text, found = self.text, BARE.match(self.text, at)
        if not found or STOP.match(text, found.end()):
            return None
        a = found.end()
        if a >= self.end:
            self.end = STOP.search(text, a).start()
            self.op = max(text.rfind("=", a, self.end), text.rfind(":", a, self.end))
            self.quote = a - 1
        if self.quote < a:
            q = QUOTE.search(text, a, self.end)
            self.quote = q.start() if q else self.end
        token = LEXEME.match(text, a, self.end)
        word = token.lastgroup in ("name", "number")
        if (token.lastgroup == "string" or word and text[token.end():token.end() + 1] == "+" and token.group() in constants
                or self.quote < self.end and text[self.quote - 1] in "([{+" or CODE.match(text, a)):
            return None
        b = self.trimmed(a, self.end)
        return None if word and token.end() >= b else (a, b, self.op >= a)

    def trimmed(self, a: int, b: int) -> int:
        """The end without ``;`` and brackets that the line opened before."""
        text = self.text
        line = text.rfind("\n", self.counted, a) + 1
        if line:
            self.open.clear()
            self.counted = line
        for z, o in OPENERS.items():
            self.open[o] += text.count(o, self.counted, a) - text.count(z, self.counted, a)
        self.counted = a
        before = dict(self.open)
        while b > a and (text[b - 1] == ";" or before.get(OPENERS.get(text[b - 1]), 0) > 0):
            o = OPENERS.get(text[b - 1])
            if o:
                if text.count(o, a, b) >= text.count(text[b - 1], a, b):
                    break
                before[o] -= 1
            b -= 1
        return b


class Value:
    """The literals of an expression: its own spans and the values of the
    constants in it, which are shared, not copied. ``best`` is the highest
    score of a name that it has reached."""

    __slots__ = ("spans", "parts", "best")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Value] = []
        self.best = 0.0

    def __bool__(self) -> bool:
        return bool(self.spans or self.parts)

    def reached(self, score: float) -> Iterator[tuple[int, int]]:
        """The spans that have not yet reached a name of this score: each is
        given at most once for each score that a name can have."""
        left = [self]
        while left:
            one = left.pop()
            if one.best < score:
                one.best = score
                yield from one.spans
                left += one.parts


#: A name that may be a value: with a digit, before the end of its line or list,
#: or another word.
NAMED_VALUE = re.compile(r"(?=[A-Za-z_$.-]*\d)[\w$.-]+(?:[ \t]*(?:[,;}\n#]|\Z)|[ \t]+(?=[A-Za-z_]))")
#: A line of an environment or properties file up to its value.
SETTING = re.compile(r"(?:export[ \t]+)?[A-Za-z_][\w.-]*=")


def setting(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is all that follows ``name=`` on its line, with no
    white space around the operator."""
    line = text.rfind("\n", max(0, a - 200), a) + 1
    m = SETTING.match(text, line, a)
    return bool(m) and m.end() == a and text[b:b + 1] in ("", "\n", "\r")


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a telling name with enough score."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, Value] = {}
    bare = Bare(text)
    spans: set[tuple[int, int]] = set()
    # Names of one target, those that the next operator may assign to, and
    # those before each open bracket.
    name, value, pending, joined = (), Value(), (), True
    calls = 0
    outer: list[tuple[str, ...]] = []
    last, declares, at, skip = None, False, 0, 0
    missed = (0, 0, 0.0)

    def literal(m: re.Match) -> tuple[int, int]:
        a, b = m.span()
        if m.lastgroup == "string":
            a += len(m.group()) - len(m.group().lstrip("rRbBuUfF@$"))
            quotes = 3 if text.startswith(('"' * 3, "'" * 3), a) and b - a > 6 else 1
            a, b = a + quotes, b - quotes
        return a, b

    def plain(m: re.Match) -> str:
        a, b = literal(m)
        return text[a:b]

    def hits(score: float, a: int, b: int) -> bool:
        """Whether a literal and its name score enough. No end of a literal
        scores more than all of it, unless that is a placeholder."""
        nonlocal missed
        if not score or missed[0] <= a and b <= missed[1] and score <= missed[2]:
            return False
        found = score * literal_score(text[a:b])
        if 0 < found < MIN_SCORE and not WHITE.search(text, a, b):
            missed = (a, b, score)
        return found >= MIN_SCORE

    def close() -> None:
        nonlocal name, value, calls
        if name and value:
            constants.update((n, value) for n in name)
            score = max(map(name_score, name))
            spans.update((a, b) for a, b in value.reached(score) if hits(score, a, b))
        name, value, calls = (), Value(), 0

    def add(m: re.Match) -> None:
        """A literal or a name as a part of the value: a name stands for its
        constant, or for itself where only a value can stand."""
        if m.lastgroup != "name":
            value.spans.append(literal(m))
        elif m.group() in constants:
            value.parts.append(constants[m.group()])
        elif NAMED_VALUE.match(text, m.start()) or setting(text, *m.span()):
            value.spans.append(m.span())

    for m in LEXEME.finditer(text):
        if m.start() < skip:
            continue
        kind, word = m.lastgroup, m.group()
        before, last = last, m
        if kind == "op" and word in ASSIGNMENTS and pending:
            typed = TYPE.match(text, m.end()) if word in (":", "?:", "!:") else None
            if typed and typed.group("quote"):
                skip = typed.end()
                continue
            close()
            name, joined = pending, True
            # The name before an unquoted value that may be a type stays.
            at = typed.end() if typed else 0
            pending = ()
            span = bare.span(m.end(), constants)
            if span:
                a, b, has_op = span
                value.spans.append((a, b))
                joined = False
                if not has_op or hits(max(map(name_score, name)), a, b):
                    skip = b
        elif kind == "op" and word == "=" and at and m.start() == at and name:
            pending, at = name, 0
            close()
            name, joined, pending = pending, True, ()
        elif kind in ("string", "name", "number") and name and (joined or kind == "string" and before.lastgroup == "string"):
            add(m)
            pending, joined = (), False
            if (kind == "name" or kind == "string") and not at:
                pending = (plain(m),)
        elif kind == "op" and word == "+":
            joined = True
        elif word == "(" and name and not at and (
                before.lastgroup == "op" or before.lastgroup == "name" and before.end() == m.start()):
            calls, joined, pending = calls + 1, True, ()  # what a call is given may be its result
        elif word == "," and calls:
            joined, pending = True, ()
        elif word == ")" and calls:
            calls, joined, pending = calls - 1, False, ()
        elif word == "\n" and calls:
            last = before
        elif kind in ("string", "name"):
            if not at or m.start() > at:
                close()
            follows = declares and before.lastgroup == "name" and not text[before.end():m.start()].strip(" \t*")
            declares = kind == "name" and (word in DECLARATIONS or bool(follows))
            pending = (pending if follows and pending[0] not in DECLARATIONS else ()) + (plain(m),)
        elif word == "[":
            after = before is not None and before.end() == m.start() and (before.lastgroup == "name" or before.group() == "]")
            outer.append(pending if after else ())
            pending = ()
        elif word == "]":
            close()
            base = outer.pop() if outer else ()
            pending = base + (pending if before is not None and before.lastgroup == "string" or before is not None
                              and text[before.start() - 1] == ":" else ())
        else:
            if kind == "end" and not (word == "\n" and joined):
                close()
                if word == "\n":
                    outer.clear()
            pending = ()
    close()
    return sorted(spans)


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), by start, then kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
        found += [(a, 3, b) for a, b in literal_spans(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>>."""
    two = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in find_spans(t.as_py() or "")]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, struct)], ["doc_id", "spans"])

    return two.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def base_digest(spans: list[tuple[int, str, int]]) -> str:
    """Hash of the base spans alone, in plain Python (for tests)."""
    return hashlib.sha256(joined([s for s in spans if s[1] != "literal"]).encode()).hexdigest()
