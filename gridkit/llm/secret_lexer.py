"""Secret scanning by assignment-aware lexing.

Three base patterns (kinds ``assign``, ``access``, ``hex``) are always reported.
The lexer adds kind ``literal``: it reads the assignments of source and
configuration syntax in a text as (name, value) pairs, keeps what each name was
last bound to, follows names bound to other names and joined literals, and
scores every literal that reaches a name by how sensitive the name is and by how
much the literal looks like a secret.  A literal counts once, where it stands.

Syntax read: ``name = "x"``, ``name := 'x'``, ``name: "x"``, ``"name": "x"``,
``name => "x"``, ``NAME=x`` and ``name: x`` (a line of its own, with or without
``export``, ``-`` or a comment after it), ``<name>x</name>``, ``name = other``,
``name = "a" + other + 'b'``, ``cfg["a" + "b"] = "x"``, ``name: { value: "x" }``;
literals in single, double, triple quotes or backticks; a value may stand on the next
line after the sign; a type may stand between the name and ``=`` (``name: str = "x"``,
``name: Option<&str> = "x"``), with brackets of any depth.  Names and values are of any
length.

Most texts hold no trigger; RE2 in Arrow sorts them out, and only the others
become Python strings.  Spans are code points, end exclusive.

Edge cases: null and empty texts have no spans; very long texts, names and values are
read whole, in time linear in a line's length; spans that start together are ordered by
kind as listed, then by end; rows that repeat a doc_id are scanned each; a null doc_id
is kept; an empty table gives an empty result; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "literal")

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: weight of a word in the name that a literal is assigned to
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "key": 0.4, "private": 0.5, "access": 0.3, "api": 0.5, "auth": 0.6,
    "credential": 0.9, "credentials": 0.9, "cred": 0.7, "bearer": 0.8, "client": 0.1, "signing": 0.4,
    "encryption": 0.4, "session": 0.3, "salt": 0.5, "connection": 0.3,
}
#: words that say the value is about a secret and is not one
NAME_DAMPERS = {"file", "path", "url", "uri", "name", "length", "len", "size", "type", "field", "label",
                "hint", "count", "id", "policy", "regex", "expiry", "ttl", "example", "header", "max", "min"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|none|null|true|false|todo|changeme|change_me|example|placeholder|"
                         r"your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|test|dummy|redacted)$", re.IGNORECASE)
THRESHOLD = 0.9
#: the most that a literal adds to its name
BEST_LITERAL = 0.5


def _trigger() -> str:
    """A text without any of these has no span of any kind (RE2): the base
    patterns, and every name that can reach the threshold, up to the sign after
    it.  Such a name has one word that is heavy enough, or two lighter ones."""
    heavy = [w for w, x in NAME_WEIGHTS.items() if x + BEST_LITERAL >= THRESHOLD]
    light = "|".join(w for w in NAME_WEIGHTS if w not in heavy)
    rest = r"""[^\s=:>"'\[\]]*"""
    return (r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
            rf"|(?i:{'|'.join(heavy)}|(?:{light}){rest}(?:{light})){rest}[\"']?(?:\][\"']?)?[!?]?[ \t]*[=:>]"
            r"|\[[\"'`][^\"'`\n]*[\"'`][ \t]*\+")  # a key joined of pieces


TRIGGER = _trigger()

# possessive throughout: a name, a literal or a space is read once
_NAME = r"[A-Za-z_][\w.\-]*+"
_TRIPLE = r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
_PLAIN = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\n]*+`"
_LITERAL = rf"(?s:{_TRIPLE})|{_PLAIN}"
_GAP = r"[ \t]*+(?:\\?\n[ \t]*+)?"  # a value may follow on the next line
_ATOM = r"(?:&[ \t]*+)?(?:'\w++[ \t]++)?(?:mut[ \t]++)?\*?"
_KEY = rf"(?:{_PLAIN})(?:[ \t]*+\+[ \t]*+(?:{_PLAIN}))*+"
#: a name, once per run of its characters, and what may stand before a sign
HEAD = re.compile(rf"""(?<![\w.\-])(?:(?![A-Za-z_])[\w.\-])*+(?P<q>["'`]?)(?P<name>{_NAME})"""
                  rf"""(?:\[(?P<part>{_KEY})\])?(?P=q)(?P<mark>[!?]?)[ \t]*+""")
SIGN = re.compile(r":=|=>|=(?!=)|:(?![:=])")
TYPED = re.compile(r":(?![:=])[ \t]*+")
ATOM = re.compile(rf"{_ATOM}(?P<type>{_NAME})")
AFTER = re.compile(r"[!?]?[ \t]*+(?P<sign>:=|=(?![=>]))")
MORE = re.compile(r"[!?]?[ \t]*+[|&][ \t]*+")
VALUE = re.compile(rf"(?P<value>(?:{_LITERAL}|{_NAME})(?:[ \t]*+[+.]{_GAP}(?:{_LITERAL}|{_NAME}))*+)")
OPEN = re.compile(rf"""\{{{_GAP}["'`]?(?:value|default|secret|data)["'`]?[ \t]*+[:=]{_GAP}""")
GAP = re.compile(_GAP)
ENV = re.compile(rf"^[ \t]*+(?:export[ \t]++)?(?P<name>{_NAME})=(?P<value>[^\s\"'#;`]++)[ \t]*+(?:#[^\n]*+)?$",
                 re.MULTILINE)
YAML = re.compile(rf"^[ \t]*+(?:-[ \t]++)?[\"']?(?P<name>{_NAME})[\"']?[ \t]*+:[ \t]++"
                  rf"(?P<value>[^\s\"'#;`{{}}\[\],|>&*!][^\s\"'#;`{{}}\[\],]*+)[ \t]*+(?:#[^\n]*+)?$", re.MULTILINE)
TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]++)</(?P=name)>")
_BRACKET = re.compile(r"[\[\]<>\n=]")
_PART = re.compile(rf"(?P<literal>{_LITERAL})|(?P<other>{_NAME})")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def name_score(name: str) -> float:
    """Sum of the weights of the name's words (snake, kebab, dotted, camel)."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in NAME_DAMPERS:
        return 0.0
    return sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words)) - 0.3 * sum(w in NAME_DAMPERS for w in words)


def literal_score(value: str) -> float:
    """From -1 (a placeholder or prose) to 0.5 (long and mixed)."""
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value.strip():
        return -1.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(BEST_LITERAL, bits / 10 + 0.1 * (kinds - 1)) if bits >= 1.5 else -1.0


def closings(text: str) -> dict[int, int]:
    """Place of the bracket that closes each one of a type: on its line, before any ``=``."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _BRACKET.finditer(text):
        c = m[0]
        if c in "[<":
            open_.append(m.start())
        elif c in "]>":
            if open_ and text[open_[-1]] == ("[" if c == "]" else "<"):
                out[open_.pop()] = m.start()
            else:
                open_.clear()
        else:
            open_.clear()
    return out


def _typed(text: str, at: int, closing: dict[int, int]) -> tuple[int, tuple[int, str]] | None:
    """Past ``type =`` at ``at``: where the value starts, and the type's first name."""
    first = None
    while m := ATOM.match(text, at):
        first = first or (m.start("type"), m["type"])
        at = m.end()
        while True:
            while at < len(text) and text[at] in " \t":
                at += 1
            if at in closing:
                at = closing[at] + 1
            else:
                break
        if more := MORE.match(text, at):
            at = more.end()
            continue
        sign = AFTER.match(text, at)
        return (sign.end(), first) if sign else None
    return None


def _parts(text: str, span: tuple[int, int]) -> list[tuple[str, object]]:
    parts: list[tuple[str, object]] = []
    for p in _PART.finditer(text, *span):
        if p["literal"]:
            width = 3 if p["literal"][:3] in ('"""', "'''") and len(p["literal"]) >= 6 else 1
            parts.append(("literal", (p.start() + width, p.end() - width)))
        else:
            parts.append(("other", p["other"]))
    return parts


def assignments(text: str) -> Iterator[tuple[int, str, list[tuple[str, object]]]]:
    """(place, target name, parts of the value); a part is ("literal", (start,
    end)) or ("other", name)."""
    closing, at = closings(text), 0
    while head := HEAD.search(text, at):
        at = head.end("name")
        name = head["name"]
        if head["part"]:  # the key, which may be joined of literals
            name = "".join(x[1:-1] for x in re.findall(_PLAIN, head["part"]))
        typed = TYPED.match(text, head.end())
        past = _typed(text, typed.end(), closing) if typed else None
        if past is None:
            sign = SIGN.match(text, head.end())
            if not sign or (head["mark"] and sign[0] != ":"):
                continue
            past = (sign.end(), None)
        start = GAP.match(text, past[0]).end()
        if inner := OPEN.match(text, start):
            start = inner.end()
        if not (value := VALUE.match(text, start)):
            continue
        at = max(at, value.end())
        parts = _parts(text, value.span("value"))
        if past[1] and name_score(past[1][1]) > 0:  # a label before a name: `note: password = "x"`
            yield past[1][0], past[1][1], parts
        yield head.start("name"), name, parts
    for pattern in (ENV, YAML, TAG):
        for m in pattern.finditer(text):
            yield m.start("name"), m["name"], [("literal", m.span("value"))]


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name."""
    bound: dict[str, list[tuple[int, int]]] = {}
    found: set[tuple[int, int]] = set()
    for _, name, parts in sorted(assignments(text), key=lambda a: a[0]):
        spans: list[tuple[int, int]] = []
        for kind, what in parts:
            if kind == "literal":
                spans.append(what)
            else:  # constant propagation: what the other name holds by now
                spans += bound.get(what, [])
        bound[name] = list(dict.fromkeys(spans))
        weight = name_score(name)
        if weight > 0 and spans:
            value = "".join(text[a:b] for a, b in spans)
            if weight + literal_score(value) >= THRESHOLD:
                found.update(s for s in spans if s[1] > s[0])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return out


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "doc_id long, spans array<struct<kind:string,start:int,stop:int,text:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                               ("text", pa.string())]))
    for batch in batches:
        texts = batch.column(1).fill_null("")
        hot = pc.match_substring_regex(texts, TRIGGER).to_pylist()
        out = []
        for i, yes in enumerate(hot):
            text = texts[i].as_py() if yes else ""
            spans = base_spans(text) + [(a, b, "literal") for a, b in lex(text)] if yes else []
            out.append([{"kind": k, "start": a, "stop": b, "text": text[a:b]} for a, b, k in _ordered(spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kind)],
                                         names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its spans: kind, start, stop and the text there."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan, SPANS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), count("literal"))
