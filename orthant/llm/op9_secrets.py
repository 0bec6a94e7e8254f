"""Secret scanning: fixed patterns plus assignment-aware lexing of source and configuration text.

The lexer turns a text into statements of a target's name and its terms:
literals, and names that other statements assign. Sensitive names pass their
weight on along these names, and each literal is scored with the greatest
weight that reaches it. Every step is linear in the text, and tokens are kept
as numbers, so one long line needs little memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import over_batches, small_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a word of a target's name; the sum, 1 at most, says how sensitive the name is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "secret": 0.9, "secrets": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "token": 0.8, "bearer": 0.7, "auth": 0.4, "key": 0.4, "private": 0.4, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.4, "client": 0.1, "salt": 0.4, "pin": 0.4}
#: Words that say that the value only names, locates or describes a secret.
HARMLESS = {"public": 0.6, "file": 0.6, "path": 0.6, "name": 0.6, "url": 0.6, "uri": 0.6, "field": 0.6, "label": 0.6, "prompt": 0.6, "type": 0.6, "length": 0.8, "len": 0.8, "min": 0.6, "max": 0.6, "count": 0.8, "hint": 0.6, "expires": 0.6, "expiry": 0.6, "header": 0.5, "policy": 0.6, "column": 0.6, "id": 0.2}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|todo|your[-_ ].*|my[-_ ]?(?:password|secret)|pass(?:word|wd|phrase)?|secret|token|<.*>|\$?\{.*\}|\$\(.*|%\(.*|redacted)$")
THRESHOLD = 0.5

_STRINGS = {'"': r'''"(?:[^"\\\n]|\\.)*+"''', "'": r"""(?<!\w)'(?:[^'\\\n]|\\.)*+'""", "`": r"`[^`\n]*+`"}
#: Kinds of tokens: groups of the lexer, in order.
_STR, _REF, _SIGNS, _SET, _PLUS, _BARE, _OTHER = range(1, 8)
_NAME = re.compile(r"[A-Za-z_@][\w.\-]*")
_REFERENCE = re.compile(r"\$?\{?[A-Za-z_][\w.]*\}?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SIGN = re.compile(r"[=:]")
_WORD = re.compile(r"\w")
_ANY_NAME = re.compile("|".join(SENSITIVE), re.I)


@lru_cache(8)
def _lexer(dead: frozenset[str]) -> re.Pattern:
    """The lexer, without strings in the quotes given."""
    strings = [p for c, p in _STRINGS.items() if c not in dead]
    return re.compile(
        (f"({'|'.join(strings)})" if strings else "((?!))")
        + r"""|(\$\{?[A-Za-z_]\w*\}?)|(==|!=|<=|>=|[(,])|(:=|=>|[=:])|(\+)|([^\s"'`=:+,;(){}\[\]<>#]+)|(\S)"""
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns. Cheap tests that any match must pass come first."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1, from its words in snake, kebab, dotted or camel case."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return max(0.0, min(1.0, sum(SENSITIVE.get(w, 0.0) - HARMLESS.get(w, 0.0) for w in words)))


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a credential, 0 to 1: length, entropy and mixed classes."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    if " " in value or "://" in value or (not quoted and classes < 2):
        return 0.2
    return min(1.0, 0.2 + 0.1 * min(n, 16) / 4 + 0.1 * entropy + 0.1 * (classes - 1))


class _Tokens:
    """The tokens of a few lines of a text: kind, start, end."""

    def __init__(self, text: str) -> None:
        self.text, self.kind, self.start, self.end = text, bytearray(), array("q"), array("q")

    def line(self, lo: int, hi: int) -> None:
        dead: set[str] = set()
        kinds, starts, ends = self.kind.append, self.start.append, self.end.append
        while True:
            for m in _lexer(frozenset(dead)).finditer(self.text, lo, hi):
                kind, (a, b) = m.lastindex, m.span()
                kinds(kind), starts(a), ends(b)
                if kind == _OTHER and (c := m[0]) in _STRINGS and not (c == "'" and _WORD.match(self.text, a - 1)):
                    dead.add(c)  # no later quote of this sort on the line is closed either: don't look again
                    lo = b
                    break
            else:
                return

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def goes_on(self) -> bool:
        """Whether the last line ends within a statement: in = := => or +, and perhaps a backslash, which is left out."""
        last = len(self.kind) - 1
        mark = last >= 0 and self.word(last) == "\\"
        last -= mark
        on = last >= 0 and (self.kind[last] == _PLUS or (self.kind[last] == _SET and self.word(last) != ":"))
        if on and mark:
            self.kind.pop(), self.start.pop(), self.end.pop()
        return on

    def target(self, i: int) -> str | None:
        """The name that the operator at place i assigns."""
        i -= 1
        kind = self.kind[i]
        if kind == _OTHER and i >= 3 and self.kind[i - 1] == _STR and self.word(i) == "]" and self.word(i - 2) == "[":
            i, kind = i - 1, _STR  # config["name"] = ...
        a, b = self.start[i], self.end[i]
        if kind == _STR:
            a, b = a + 1, b - 1
        elif kind != _BARE:
            return None
        m = _NAME.fullmatch(self.text, a, b)
        return m and m[0]

    def value(self, j: int) -> tuple[int, int]:
        """Last token and end of the bare value that begins at token j: it goes on to the next blank over + = : but not into another assignment."""
        kind, start, end, last = self.kind, self.start, self.end, len(self.kind) - 1
        stop = end[j]
        while j < last and start[j + 1] == stop:
            k = kind[j + 1]
            if k == _SET:
                if j + 1 < last and start[j + 2] == end[j + 1] and kind[j + 2] in (_BARE, _STR, _REF) and kind[j] == _BARE and _NAME.fullmatch(self.text, start[j], stop):
                    break
            elif k not in (_BARE, _PLUS) and not (k == _SIGNS and self.text[stop] not in "(,"):
                break
            j += 1
            stop = end[j]
        return j, stop


def _statements(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool, str | None]]]]:
    """(target, terms) of each assignment, where a term is (start, end, quoted, name it refers to)."""
    done = -1
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        lo, tokens = max(text.rfind("\n", max(done, 0), sign.start()), done) + 1, _Tokens(text)
        while True:  # a line, and those it goes on to
            done = text.find("\n", max(lo, sign.start()) if not tokens.kind else lo)
            done = len(text) if done < 0 else done
            tokens.line(lo, done)
            if done == len(text) or not tokens.goes_on():
                break
            lo = done + 1
        kinds, starts, ends = tokens.kind, tokens.start, tokens.end
        n, i = len(kinds), 0
        while 0 < (i := kinds.find(_SET, i + 1)) < n - 1:
            if (target := tokens.target(i)) is None:
                continue
            terms, j = [], i + 1
            while j < n:
                kind, start, end = kinds[j], starts[j], ends[j]
                if kind == _STR:
                    terms.append((start + 1, end - 1, True, None))
                elif kind == _BARE or kind == _REF:
                    if kind == _BARE:
                        j, end = tokens.value(j)
                    m = _REFERENCE.fullmatch(text, start, end)
                    terms.append((start, end, False, m and m[0].strip("${}")))
                else:
                    break
                if j + 1 < n and kinds[j + 1] == _PLUS:
                    j += 2
                else:
                    break
            if terms:
                yield target, terms


def _key(name: str) -> str:
    return name.rpartition(".")[2] or name


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the literals that reach a sensitive name, directly, by concatenation or through constants.

    Names are nodes, a name in another's terms is an edge. From the most
    sensitive name on, each name is visited once, so the first weight that
    reaches it is its greatest; literals are scored with that. A name that is
    assigned somewhere is never a literal itself.
    """
    if not _SIGN.search(text) or not _ANY_NAME.search(text):
        return []
    number: dict[str, int] = {}
    owner, start, end, quoted, refers = array("q"), array("q"), array("q"), bytearray(), array("q")
    names: dict[str, int] = {}  # that terms refer to
    targets: dict[str, int] = {}
    for target, terms in _statements(text):
        n = targets.get(target)
        if n is None:
            n = targets[target] = number.setdefault(_key(target), len(number))
        for a, b, q, name in terms:
            owner.append(n)
            start.append(a)
            end.append(b)
            quoted.append(q)
            refers.append(-1 if name is None else names.setdefault(_key(name), len(names)))
    weight: dict[int, float] = {}
    for target, n in targets.items():
        if (w := name_score(target)) >= THRESHOLD:  # a literal scores 1 at most
            weight[n] = max(w, weight.get(n, 0))
    if not weight:
        return []
    order = np.argsort(np.frombuffer(owner, np.int64), kind="stable")
    first = np.searchsorted(np.frombuffer(owner, np.int64)[order], np.arange(len(number) + 1))
    at = [number.get(name, -1) for name in names]
    found, seen = set(), bytearray(len(number))
    for source in sorted(weight, key=weight.__getitem__, reverse=True):
        queue = [] if seen[source] else [source]
        seen[source] = 1
        while queue:
            node = queue.pop()
            for t in order[first[node] : first[node + 1]].tolist():
                to = at[refers[t]] if refers[t] >= 0 else -1
                if to >= 0:
                    if not seen[to]:
                        seen[to] = 1
                        queue.append(to)
                elif start[t] < end[t] and weight[source] * literal_score(text[start[t] : end[t]], bool(quoted[t])) >= THRESHOLD:
                    found.add((start[t], 3, end[t]))
    return sorted(found)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each as sorted (start, kind, end) in code points."""
    text = text or ""
    base = sorted(base_spans(text))
    return base, sorted(base + literal_spans(text))


def _say(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal for each row; one pass without a shuffle.

    A null or empty text has no spans. Every text is read whole; equal rows
    each get a row; other columns are not read.
    """

    small_batches(docs)

    @over_batches
    def run(batch):
        counts, digests, said = ([], [], [], []), [], []
        for text in batch.column("text").to_pylist():
            base, every = spans(text)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in every))
            digests.append(hashlib.sha256(_say(base).encode()).hexdigest())
            said.append(_say(every))
        counted = {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)}
        literal = counted.pop("n_literal")
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64())} | counted | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(said, pa.string()), "n_literal": literal})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each group of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts are replaced by a mark, and n_chars follows where a text changed."""
    small_batches(docs)
    schema, at = docs.schema, docs.columns.index("text")

    @over_batches
    def run(batch):
        old = batch.column(at).to_pylist()
        new = [redact(t) if t else t for t in old]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if "n_chars" in batch.schema.names:
            k = batch.schema.names.index("n_chars")
            sizes = [n if a is b or a == b else len(b) for n, a, b in zip(batch.column(k).to_pylist(), old, new, strict=True)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
        return batch

    return docs.mapInArrow(run, schema)


__all__ = ["base_spans", "literal_spans", "query", "redact", "scan", "spans", "stage"]
