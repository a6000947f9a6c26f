"""Secret scan by assignment-aware lexing.

The base patterns are found in every text. Beyond them, source and configuration syntax is lexed
into name-literal pairs (``name = "x"``, ``"name": "x"``, ``name: x``, ``name := x``, ``name => x``,
``export NAME=x``, ``env["NAME"] = x``, ``name: type = x``, ``a = b = x``); constants are propagated
through names and through concatenation, so that a literal bound to a plain name and later given to
a sensitive one is found where it stands; and a literal is scored by the name it reaches, its length,
its alphabet and its entropy. A regular-expression automaton over the Arrow buffers selects the texts
that can hold a match at all; only those become Python strings.

A text of any length takes time and memory in proportion to it: names and literals are matched
possessively from the places where they can begin, and a constant is a node that points to the
constants it is made of, with the statistics of its value but not the value, so that a constant
doubled a thousand times is a thousand nodes. Each node is visited once when spans are marked.

Defined results: null counts as empty; a text without spans has empty strings hashed; spans are in
code points, ends exclusive; a concatenation is scored as a whole, by the entropy of its bytes; a
lexed literal inside a base span is not listed again; repeated rows are answered once each; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A text without a match of this has no base span (the automaton folds more letters than ASCII's).
MAYBE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
#: A text without this has no pair of name and literal: it takes what PAIR takes, and more.
PAIR_MAYBE = r"[A-Za-z0-9_.\-)\]\"']\s*(?:(?:=>|:=|=)\s*[^\s(){}\[\],;#=:]|:(?:\s+[^\s(){}\[\],;#=:]|[^\s(){}\[\],;#=:/]))"

#: A name begins where its run of letters does, so that a run is read once.
NAME = r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)(?:["']?\s*+\])?["']?"""
LITERAL = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
#: A plus sign before a quote joins; inside a word it is a letter of it.
BARE = r"""(?:[^\s"'(){}\[\],;#=:+]|\+(?!["']))++"""
TERM = rf"(?:(?:[bBrRuUfF]{{1,2}}(?=[\"']))?{LITERAL}|{BARE})"
PAIR = re.compile(rf"{NAME}[ \t]*+(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*+({TERM}(?:[ \t]*+\+[ \t]*+{TERM})*+)")
PART = re.compile(rf"[ \t]*+(?:\+[ \t]*+)?({TERM})")
#: The value of a pair is itself the name of a further one.
CHAINED = re.compile(r"[ \t]*+(?:=>|:=|=(?![=>]))")
IDENTIFIER = re.compile(r"\$?[A-Za-z_][A-Za-z0-9_.]*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Weights of name words (fixed values), alone or joined with the one before.
STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "bearer", "privatekey", "accesskey", "secretkey", "authkey", "signingkey", "encryptionkey", "authtoken", "accesstoken"}
WEAK = {"auth", "key", "pass", "salt", "cookie", "session", "signature", "connectionstring", "dsn"}
PLACEHOLDER = re.compile(r"^(?:changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|x+|\*+|none|null|true|false|todo|test)$", re.IGNORECASE)
LEAST_SCORE = 4.0


def name_weight(name: str) -> float:
    """How sensitive a target name is: 3 for secrets by name, 1.5 for hints of one, 0 else."""
    words = [w.lower() for w in WORDS.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    if any(w in STRONG for w in words + joined):
        return 3.0
    return 1.5 if any(w in WEAK for w in words + joined) else 0.0


KINDS_OF_LETTERS = tuple(re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]", r"\s"))
#: Counts stay finite however often a constant doubles.
MOST = 1e300


class Constant:
    """What a name stands for: one literal of the text, or the constants it joins."""

    __slots__ = ("counts", "found", "head", "kinds", "last", "parts", "size", "span", "text")

    def __init__(self, text: str | None, span: tuple[int, int] | None, parts: tuple = ()):
        self.text, self.span, self.parts, self.found, self.counts = text, span, parts, False, None
        if parts:
            for p in parts:
                p.measure()
            self.size = min(sum(p.size for p in parts), MOST)
            self.counts = np.minimum(sum(p.counts for p in parts), MOST)
            self.kinds = [any(k) for k in zip(*(p.kinds for p in parts), strict=True)]
            self.head = ""
            for p in parts[:16]:
                self.head = (self.head + p.head)[:16]
            self.last = next((p.last for p in reversed(parts) if p.last), "")

    def measure(self) -> None:
        if self.counts is None:
            t = self.text
            self.size, self.head, self.last = float(len(t)), t[:16], t[-1:]
            self.counts = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256).astype(float)
            self.kinds = [bool(p.search(t)) for p in KINDS_OF_LETTERS]

    def placeholder(self) -> bool:
        if self.size <= 16:
            return bool(PLACEHOLDER.match(self.head))
        total, of = self.counts.sum(), lambda c: self.counts[[ord(x) for x in c]].sum()
        return of("xX") == total or of("*") == total or self.head[:5].lower() in ("your_", "your-") or (self.head[0] == "<" and self.last == ">") or (self.head[:2] == "${" and self.last == "}")

    def score(self) -> float:
        self.measure()
        if self.size < 6 or self.kinds[4] or self.placeholder():
            return -9.0
        p = self.counts[self.counts > 0]
        p = p / p.sum()
        entropy = -float((p * np.log2(p)).sum())
        return min(self.size, 24) / 24 + min(entropy, 4.0) / 4.0 + 0.25 * sum(self.kinds[:4]) + (0.75 if self.kinds[2] else -0.5)

    def mark(self) -> list[tuple[int, int]]:
        """The spans of its literals that have not been marked before."""
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if not c.found:
                c.found = True
                todo += c.parts
                if c.span:
                    out.append(c.span)
        return out


def lex(text: str):
    """(target name, its constant) of every pair, constants propagated."""
    constants: dict[str, Constant] = {}
    at, waiting = 0, []

    def known(raw: str) -> list[Constant] | None:
        """The constants that a bare word names, alone or joined by plus signs."""
        names = [x.lstrip("$") for x in raw.split("+")]
        return [constants[x] for x in names] if all(x in constants for x in names) else None

    while m := PAIR.search(text, at):
        if IDENTIFIER.fullmatch(m[2]) and CHAINED.match(text, m.end(2)):
            waiting.append(m[1])  # name = name = ..., or name: type = ...
            at = m.start(2)
            continue
        parts, place = [], m.start(2)
        while place < m.end(2) and (p := PART.match(text, place, m.end(2))):
            place, (s, e) = p.end(), p.span(1)
            raw = text[s:e]
            if raw[-1] in "\"'":
                s += raw.index(raw[-1])
                parts.append(Constant(text[s + 1 : e - 1], (s + 1, e - 1)))
            else:
                parts += known(raw) or [Constant(raw, (s, e))]
        value = parts[0] if len(parts) == 1 else Constant(None, None, tuple(parts))
        for name in [*waiting, m[1]]:
            constants[name] = value
            yield name, value
        at, waiting = m.end(), []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def lexed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Scored literals outside the base spans."""
    found = set()
    for name, value in lex(text):
        weight = 0.0 if value.found else name_weight(name)
        if weight and weight + value.score() >= LEAST_SCORE:
            found.update(value.mark())
    if not found:
        return []
    starts = sorted((s, e) for s, _, e in base)
    reach = list(accumulate((e for _, e in starts), max))

    def covered(s: int, e: int) -> bool:
        at = bisect_right(starts, s, key=lambda x: x[0])
        return at > 0 and reach[at - 1] >= e

    return sorted((s, 3, e) for s, e in found if e > s and not covered(s, e))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text: str) -> tuple[int, int, int, str, str]:
    """(assign, access, hex, base spans spelled, all spans spelled) of a text."""
    base = base_spans(text)
    kinds = [k for _, k, _ in base]
    return kinds.count(0), kinds.count(1), kinds.count(2), spell(base), spell(base + lexed_spans(text, base))


def _scan(batches):
    empty = (0, 0, 0, "", "")
    for rb in batches:
        col = rb.column(1)
        maybe = pc.fill_null(pc.or_(pc.match_substring_regex(col, MAYBE), pc.match_substring_regex(col, PAIR_MAYBE)), False)
        at = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
        rows = [empty] * rb.num_rows
        for k, text in zip(at.tolist(), col.take(pa.array(at)).to_pylist(), strict=True):
            rows[k] = scan(text)
        a, b, c, base, every = zip(*rows, strict=True) if rows else ([],) * 5
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
        yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans, their digest, and all spans spelled."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("doc_id", id_col)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
