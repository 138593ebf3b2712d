"""Secret scans: assignment-aware lexing of source and configuration text.

Base patterns mark assignments to well-known names, access keys and long hex runs. On top of them a lexer reads
pairs of a name and a value, in the syntaxes of source code, shell, INI, JSON, YAML and XML:

- ``name op value``, where op is ``=``, ``:``, ``:=``, ``=>``, ``+=``, ``?=`` or ``||=``; the name may be quoted, a quoted subscript, or have a type
  (``password: str = ...``); also ``#define name "value"``;
- calls of setters, ``setPassword("...")``, and of a key with a value, ``put("password", "...")``;
- elements, ``<password>...</password>``, and neighbours ``name="password" value="..."``, also ``name: ...`` before ``value: ...``.

A value is made of quoted literals (with prefixes, in three quotes, or side by side), bare words, names, lists, calls, and what ``+`` joins; or it is a
block of YAML lines. What a call that only looks a value up is given (``getenv("...")``) is no value. Names that stand for literals hand
them on, over any number of steps (the last assignment before the use wins). A literal is a secret if the best score of the names that it
reaches times the score of its own characters is at least ``THRESHOLD``.

Spans are (kind, start, end) in code points, end exclusive, in order of start and then of KINDS; repeats of a span
count once among the lexer's, as constants may reach several names.

Cases: a null or empty text has no spans; repeated rows are each scanned; an empty table gives an empty table;
further columns are ignored, whatever their names; very long texts, and long chains of names, take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

NAME = r"[A-Za-z_$][\w.$-]*+"
#: Where a value begins: a name and an operator, the opening bracket of a call before a quote, or a macro.
TARGET = rf"""(?<![\w.$-])(?:(?P<q>["'])(?P<key>{NAME})(?P=q)\]?+|(?P<name>{NAME})(?:\[\d*+\])?+)(?:[ \t]*+(?::=|=>|(?:\|\||[?+])?=(?![=>~])|(?P<colon>:(?![:/=])))[ \t]*+|(?P<call>\()(?=\s*+["']))|\#[ \t]*+define[ \t]++(?P<macro>{NAME})[ \t]++(?=["'])"""
START = re.compile(TARGET, re.ASCII)
#: What may come in a value.
TOKEN = re.compile(rf"""(?P<space>[ \t&*]++)|(?P<blank>\n[ \t\r]*+\n)|(?P<line>\r?\n)|(?P<target>{TARGET})|[fFrRbBuU]{{0,2}}(?P<quote>\"\"\"|\'\'\'|["'`])|(?P<open>(?P<of>{NAME})?+[(\[{{])|(?P<close>[)\]}}])|(?P<plus>\+(?=[\s"'A-Za-z_]))|(?P<comma>,)|(?P<is>=(?![=>~]))|(?P<word>{NAME}(?![/+=@!%^*~\\|]|:\S))|(?P<bare>[^\s,;"'`#(){{}}\[\]<>?&]++)""", re.ASCII)
BLOCK = re.compile(r"[|>][+-]?\d?[ \t]*+\r?\n")
CLOSE = {q: re.compile(rf"(?:[^\\{q}\n]|\\.)*+{q}") for q in "\"'`"}
ELEMENT = re.compile(rf"<(?P<tag>{NAME})(?:\s[^<>]*+)?>(?P<text>[^<>]++)</(?P=tag)\s*+>", re.ASCII)
ONLY_NAME = re.compile(NAME, re.ASCII)
BETWEEN = re.compile(r"[\s,;-]*+")
SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# What a target name's parts say about its value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "pass": 0.7, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.5, "api": 0.5, "key": 0.5, "salt": 0.5, "session": 0.4, "client": 0.2}
HARMLESS = {"public": 0.6, "count": 0.8, "max": 0.6, "min": 0.6, "len": 0.6, "length": 0.8, "size": 0.8, "type": 0.7, "name": 0.6, "path": 0.6, "file": 0.6, "url": 0.6, "field": 0.7, "label": 0.7, "hint": 0.8, "id": 0.3, "expiry": 0.8, "ttl": 0.8}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "dummy", "sample", "redacted", "none", "null", "undefined", "todo")
SETTERS = {"set", "with", "put", "add", "use", "assign", "configure", "login", "authenticate"}
LOOKUPS = {"get", "getenv", "env", "environ", "lookup", "fetch", "load", "read", "find", "input", "prompt", "require", "config", "param", "option", "argument", "gettext", "len", "print", "log", "format"}
NAMING = {"name", "key", "id", "property"}
THRESHOLD = 0.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def subwords(name: str) -> list[str]:
    return [p.lower() for p in SUBWORD.findall(name)]


def name_score(name: str) -> float:
    parts = subwords(name)
    plus = 1 - math.prod(1 - SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0)) for p in parts)
    return plus * math.prod(1 - HARMLESS.get(p, 0) for p in parts)


def literal_score(literal: str) -> float:
    """0 to 1: long, varied and without spaces is likely a secret; placeholders and templates are not."""
    n = len(literal)
    low = literal.lower()
    if n < 8 or any(c.isspace() for c in literal) or any(p in low for p in PLACEHOLDERS) or low.startswith(("http:", "https:", "${", "{{", "<", "%(", "/")):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, n / 12) * min(1.0, entropy / 2.5) * (0.4, 0.4, 0.9, 1.0, 1.0)[classes]


class Target:
    """A name with its value: where both stand, the value's parts (start, end, whether it is a bare word), and whether the name can be used later."""

    __slots__ = ("name", "start", "end", "parts", "bound", "depth", "wanted", "colon", "is_call", "has_key")

    def __init__(self, m: re.Match, depth: int):
        self.name, self.start, self.end, self.parts = m["key"] or m["name"] or m["macro"], m.start(), m.end(), []
        self.is_call, self.has_key, self.colon = bool(m["call"]), False, bool(m["colon"])
        self.bound, self.depth, self.wanted = not self.is_call, depth, True  # how many brackets were open; whether an operand may come


class Reader:
    """Reads the targets of a text, in order of their starts; every character is read a bounded number of times."""

    def __init__(self, text: str):
        self.text, self.targets, self.unclosed = text, [], set()

    def quoted(self, m: re.Match) -> tuple[int, int, int] | None:
        """The quoted literal without blanks around it, and where the text goes on."""
        text, quote, a = self.text, m["quote"], m.end()
        if len(quote) == 1:
            closed = CLOSE[quote].match(text, a)
            return (a, closed.end() - 1, closed.end()) if closed else None
        end = -1 if quote in self.unclosed else text.find(quote, a)
        if end < 0:
            self.unclosed.add(quote)
            return None
        inner = text[a:end]
        a += len(inner) - len(inner.lstrip())
        return a, a + len(inner.strip()), end + 3

    def block(self, t: Target, a: int) -> int:
        """Takes the lines from there on that are indented by more than the target's; where they end."""
        text = self.text
        head = text[text.rfind("\n", 0, t.start) + 1 : t.start]
        indent = len(head) - len(head.lstrip(" -"))
        while a < len(text):
            end = text.find("\n", a)
            end = len(text) if end < 0 else end
            line = text[a:end]
            if line.strip():
                depth = len(line) - len(line.lstrip())
                if depth <= indent:
                    break
                t.parts.append((a + depth, a + len(line.rstrip()), False))
                t.end = a + len(line.rstrip())
            a = end + 1
        return min(a, len(text))

    def read(self) -> list[Target]:
        at = 0
        while m := START.search(self.text, at):
            at = max(m.end(), self.value(m))
        return self.targets

    def value(self, m: re.Match) -> int:
        """Reads a target and those within its value; where they end."""
        text, stack, brackets, lookups = self.text, [], [], []  # lookups: the places of the open brackets that look something up

        def opened(kind: str) -> None:
            if kind == "lookup":
                lookups.append(len(brackets))
            brackets.append(kind)

        def begin(m: re.Match) -> int:
            if m["call"]:
                opened("call")
            t = Target(m, len(brackets))
            self.targets.append(t)
            if t.colon and (b := BLOCK.match(text, m.end())):
                return self.block(t, b.end())
            stack.append(t)
            return m.end()

        at = begin(m)
        while stack and (k := TOKEN.match(text, at)):
            t = stack[-1]
            nested = len(brackets) > t.depth or t.is_call
            looked_up = bool(lookups) and lookups[-1] >= t.depth
            if k["space"]:
                at = k.end()
            elif k["blank"]:
                break
            elif k["line"] or k["comma"]:
                if not nested:
                    stack.pop()
                    continue
                if k["comma"] and t.is_call and not t.has_key and len(brackets) == t.depth and len(t.parts) == 1 and name_score(t.name) < THRESHOLD and ONLY_NAME.fullmatch(text, *t.parts[0][:2]):
                    lookup = set(subwords(t.name)) & LOOKUPS
                    t.name, t.parts, t.has_key = "" if lookup else text[slice(*t.parts[0][:2])], [], True  # a call of a key with its value
                at, t.wanted = k.end(), True
            elif k["target"]:
                if k["call"] and t.wanted and subwords(k["name"] or "")[:1] != ["set"]:  # a call in a value hands on what it is given
                    opened("lookup" if set(subwords(k["name"] or "")) & LOOKUPS else "call")
                    at = k.end()
                elif t.colon and not t.parts and not nested and k["name"]:
                    at, t.colon = k.end(), False  # a type
                elif nested or not t.parts:
                    at = begin(k)
                else:
                    stack.pop()
            elif k["quote"]:
                found = self.quoted(k)
                if found and not looked_up:
                    t.parts.append((*found[:2], False))
                if not found and not nested:
                    break
                at, t.colon = found[2] if found else k.end(), False
                t.end = at
            elif k["open"]:
                if not t.wanted and not nested and not t.colon:
                    stack.pop()
                    continue
                opened("lookup" if k["of"] and set(subwords(k["of"])) & LOOKUPS else "open")
                at, t.wanted = k.end(), True
            elif k["close"]:
                if not brackets:
                    break
                if brackets.pop() == "lookup":
                    lookups.pop()
                at = k.end()
                while stack and stack[-1].depth > len(brackets):
                    stack.pop()
                if stack:
                    stack[-1].wanted, stack[-1].end = False, at
            elif k["plus"]:
                at, t.wanted = k.end(), True
            elif k["is"]:
                if not t.colon or nested:
                    break
                t.parts, t.wanted, t.colon, at = [], True, False, k.end()  # what came was a type
            else:
                if not nested and (not t.wanted or t.parts and text[t.parts[-1][1] : k.start()].strip(" \t\"'`") == ""):
                    stack.pop()
                    continue
                if not looked_up and (k["word"] or not nested):
                    t.parts.append((k.start(), k.end(), bool(k["word"])))
                at, t.wanted = k.end(), False
                t.end = at
        return at


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the literals that reach a sensitive name."""
    if not any(c in text for c in "=:(<#"):
        return []
    targets, bound, scores = Reader(text).read(), {}, {}
    for i, t in enumerate(targets):
        if t.is_call and not t.has_key and subwords(t.name)[:1] and not set(subwords(t.name)) & SETTERS:
            t.parts = []
        if t.bound and t.parts:
            starts, numbers = bound.setdefault(t.name, ([], []))
            starts.append(t.start)
            numbers.append(i)
        if t.name not in scores:
            scores[t.name] = name_score(t.name)
    own = [scores[t.name] for t in targets]
    for t, i in zip(targets, range(1, len(targets))):  # a name that is a value itself, beside its value
        following = targets[i]
        if t.name.lower() in NAMING and following.name.lower() == "value" and len(t.parts) == 1 and BETWEEN.fullmatch(text, t.end, following.start):
            own[i] = max(own[i], name_score(text[slice(*t.parts[0][:2])]))
    best, found = list(own), set()
    for i in reversed(range(len(targets))):
        t = targets[i]
        for a, b, word in t.parts:
            of = bound.get(text[a:b]) if word else None
            j = bisect_left(of[0], t.start) - 1 if of else -1
            if j >= 0:  # the last value that the name was given before; it stands earlier, so its own names come later here
                best[of[1][j]] = max(best[of[1][j]], best[i])
            elif (own if word else best)[i] >= THRESHOLD and (own if word else best)[i] * literal_score(text[a:b]) >= THRESHOLD:
                found.add(("literal", a, b))
    if "</" in text:
        for m in ELEMENT.finditer(text):
            inner = m["text"].strip()
            score = name_score(m["tag"])
            if score >= THRESHOLD and score * literal_score(inner) >= THRESHOLD:
                a = m.start("text") + len(m["text"]) - len(m["text"].lstrip())
                found.add(("literal", a, a + len(inner)))
    return list(found)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret value replaced by a mark; of an assignment only the value goes."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(a, b) for kind, a, b in base_spans(text) if kind != "assign"] + [(a, b) for _, a, b in lexed_spans(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (text form of the base spans), spans (of all), and the number of base spans by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [], [], [], [], []
            for text in strings(batch.column(1)):
                text = text or ""
                base = base_spans(text)
                kinds = Counter(k for k, _, _ in base)
                for column, value in zip(rows, (kinds["assign"], kinds["access"], kinds["hex"], digest(base), digest(in_order(base + lexed_spans(text))))):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), *(pa.array(x, pa.string()) for x in rows[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, if there is one, set anew; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([None if x is None else redacted(x) for x in strings(batch.column(i))], batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op10_secret_scans": op10_secret_scans}
ORACLES: dict[str, str] = {}
