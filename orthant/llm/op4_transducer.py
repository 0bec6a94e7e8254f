"""BPE encoding and decoding through a minimal acyclic transducer.

The frequent words of the corpus are compiled into a shared-suffix automaton
that numbers its words; the number leads to a word's ids. The automaton is one
file of flat arrays that every worker maps into memory, and a batch's distinct
words walk through it side by side. Words that it does not have are merged
exactly by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, Scratch, list_column, small_batches, table
from .op10_packing import byte_alphabet
from .segment import IdMemo, pieces, unsure
from .textvec import code_points, distinct_runs

#: Words compiled into the automaton, the most frequent of the corpus of at most LONGEST characters.
LEXICON, LONGEST = 65_536, 64
#: Words remembered by a worker; beyond that it forgets all and goes on, with the same results.
MEMO = 400_000
#: Bytes of a word that is merged side by side with others; longer ones are merged alone.
SHORT = 64
_BLOCK = 1 << 20


class Merger:
    """The library's ids of single words and its token strings, from a vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.letter = {b: c for c, b in byte_alphabet().items()}
        # symbols: vocabulary ids, and numbers beyond them for strings that only merges know
        number, beyond = dict(vocab), max(self.token, default=0) + 1
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        strings = [self.letter[b] + end for end in ("", suffix) for b in range(256)] + [x for a, b in merges for x in (a, b, a + b)]
        for x in strings:
            number.setdefault(x, beyond + len(number))
        self.known = set(vocab.values())
        self.symbols = np.array([number[x] for x in strings[:512]]).reshape(2, 256)
        pairs = {number[a] << 32 | number[b]: (k, number[a + b]) for k, (a, b) in enumerate(merges)}
        self.rule = {key: k << 32 | made for key, (k, made) in pairs.items()}
        self.pairs, self.merged, self.ranks = (np.array(x, np.int64) for x in zip(*sorted((key, made, k) for key, (k, made) in pairs.items()), strict=True)) if pairs else (np.empty(0, np.int64),) * 3

    def all_ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words: short ones side by side, long ones alone."""
        short = [w for w in words if len(w) <= SHORT]
        found = iter(self._side_by_side(short))
        return [next(found) if len(w) <= SHORT else self.ids(w) for w in words]

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        """In each round, every word merges its pair of least rank."""
        if not words or not len(self.pairs):
            return [self.ids(w) for w in words]
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(flat), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        symbol, word = self.symbols[last, flat], np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1) << 40
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.append(np.where((self.pairs[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            spread = np.repeat(least, np.diff(np.append(first, len(word))))
            over = spread == none  # words without a pair leave
            if over.any():
                done.append((word[over], symbol[over]))
            hit = (rank == spread) & ~over
            where = np.flatnonzero(hit)
            # of a run of overlapping equal pairs, every other one
            run = np.append(True, np.diff(where) > 1) if len(where) else np.empty(0, bool)
            start = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))] if len(where) else where
            where = where[(where - start) % 2 == 0]
            symbol = symbol.copy()
            symbol[where] = self.merged[at[where]]
            keep = ~over
            keep[where + 1] = False
            symbol, word = symbol[keep], word[keep]
        done.append((word, symbol))
        word, symbol = (np.concatenate([x[k] for x in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        symbol = symbol[order].tolist()
        cuts = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        return [[i for i in symbol[a:b] if i in self.known] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, word: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost first, until none is left: a heap of pairs over a linked list, n log n in the word's length."""
        n = len(word)
        if not n:
            return []
        symbol = self.symbols[0, np.frombuffer(word, np.uint8)]
        symbol[-1] = self.symbols[1, word[-1]]
        symbol = symbol.tolist()
        rule, right, left = self.rule.get, list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is a rank and a place; it counts only while that rank is the place's
        heap = [r >> 32 << 32 | i for i, r in enumerate(map(rule, map(lambda a, b: a << 32 | b, symbol, symbol[1:]))) if r is not None]
        heapq.heapify(heap)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << 32) - 1
        while heap:
            top = pop(heap)
            i = top & mask
            j = right[i]
            if symbol[i] < 0 or j >= n:
                continue
            r = rule(symbol[i] << 32 | symbol[j])
            if r is None or r >> 32 != top >> 32:
                continue
            symbol[i], symbol[j] = r & mask, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rule(symbol[i] << 32 | symbol[k])
                if r is not None:
                    push(heap, r >> 32 << 32 | i)
            k = left[i]
            if k >= 0:
                r = rule(symbol[k] << 32 | symbol[i])
                if r is not None:
                    push(heap, r >> 32 << 32 | k)
        return [i for i in symbol if i in self.known]


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with their ids as outputs, as a file's content.

    Words come in sorted order; the states of a finished suffix are merged
    with equal ones. An edge holds how many words sort before it from its
    state on, so the sum along a path is the word's number.
    """
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # of numbered states: final, edges

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(done)
            done.append(key)
        return at

    path: list[list] = [[False, []]]  # open states: final, edges by byte
    last = b""
    for word in sorted(words):
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    below: list[int] = []  # words from each state on; targets are numbered before their sources
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(done):
        count = int(final)
        for byte, target in edges:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(count)
            count += below[target]
        below.append(count)
    outputs = [words[w] for w in sorted(words)]
    arrays = [np.array([root]), np.array(keys), np.array(targets), np.array(skips), np.array([f for f, _ in done]), np.cumsum([0, *map(len, outputs)]), np.array([i for x in outputs for i in x])]
    return np.concatenate([[len(arrays)], [len(a) for a in arrays], *arrays]).astype("<i4").tobytes()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        flat = np.memmap(path, "<i4", "r")
        sizes = flat[1 : 1 + int(flat[0])].astype(np.int64)
        cuts = np.cumsum([1 + len(sizes), *sizes])
        root, self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.root = int(root[0])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it is not in the lexicon; all words take a step at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        out = np.full(len(words), -1)
        for step in range(int(sizes.max(initial=0)) + 1):
            over = sizes[live] == step
            ended = live[over]
            accepted = ended[self.final[state[ended]] == 1]
            out[accepted] = number[accepted]
            live = live[~over]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | flat[starts[live] + step].astype(np.int64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            number[live] += self.skips[at]
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


def _normal(texts: list[str | None], library) -> list[str]:
    """The library's normal form: composed, white space runs as one blank, lower case. Texts of plain Latin letters need no composing."""
    out = []
    for t in texts:
        t = t or ""
        low = t.lower()
        # white space is dropped when words are cut, so it may stay as it is
        out.append(low if t.isascii() or (max(t) < "̀" and len(low) == len(t)) else library.normalizer.normalize_str(t))
    return out


def _words(texts: list[str]):
    """For blocks of normal texts: first text, points, starts and ends of words, offsets of texts."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
            size += len(texts[hi])
            hi += 1
        points, offsets = code_points(texts[lo:hi])
        yield lo, points, *pieces(points, offsets, spaces=False), offsets
        lo = hi


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n over all documents: counted per task, then summed. Words of more than LONGEST characters are no candidates for the lexicon and left out."""

    def run(batches):
        library, counts = merger(path).library, {}

        def told():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for _, points, starts, ends, _ in _words(_normal(batch.column("text").to_pylist(), library)):
                short = ends - starts <= LONGEST
                starts, ends = starts[short], ends[short]
                first, back = distinct_runs(points, starts, ends)
                whole = points.tobytes().decode("utf-32-le")
                for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), np.bincount(back, minlength=len(first)).tolist(), strict=True):
                    word = whole[a:b]
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > MEMO:
                yield told()
                counts = {}
        if counts:
            yield told()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, size: int) -> list[str]:
    """The most frequent words, `size` at most: all that are at least as frequent as the lowest eighth of an octave that still fits.

    Only a histogram of some hundred rows and the words themselves reach the
    driver.
    """
    words = words.withColumn("octave", F.floor(F.log2("n") * 8))
    least, total = None, 0
    for r in words.groupBy("octave").agg(F.count("*").alias("words")).orderBy(F.desc("octave")).collect():
        total += r["words"]
        if total > size:
            break
        least = r["octave"]
    if least is None:
        return []
    return [r["word"] for r in words.where(F.col("octave") >= least).select("word").collect()]


def build(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile the most frequent words of all documents into a file of the shared folder; returns the name under which executors find their copy."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "words")
    words = [w.encode() for w in frequent(scratch.save(count_words(docs, path), "counts"), size)]
    scratch.drop("counts")
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = scratch.put(compile_lexicon(dict(zip(words, merger(path).all_ids(words), strict=True))), name)
    spark.sparkContext.addFile(at)
    return name


@lru_cache(2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Strings:
    """Joins strings, one for each id, with a blank between; unknown ids are left out."""

    def __init__(self, names: dict[int, str]) -> None:
        raw = [names[i].encode() + b" " if i in names else b"" for i in range(max(names, default=-1) + 1)]
        self.size = np.array([len(x) for x in raw] + [0], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The joined strings of each range ids[cuts[i]:cuts[i + 1]]."""
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, -1)
        sizes = self.size[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        said = self.flat[np.repeat(self.first[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        at = total[cuts].tolist()
        return [said[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def tokens_of(path: str) -> Strings:
    return Strings(merger(path).token)


@lru_cache(2)
def decimals_of(path: str) -> Strings:
    return Strings({i: str(i) for i in merger(path).token})


class Coder:
    """Encodes texts with a lexicon and exact merges; remembers what it has seen."""

    def __init__(self, words: Lexicon, merge: Merger) -> None:
        self.words, self.merge = words, merge
        self.memo = IdMemo(self._find, MEMO)

    def _find(self, names: list[str]) -> list[list[int]]:
        raw = [n.encode() for n in names]
        numbers = self.words.find(raw).tolist()
        merged = iter(self.merge.all_ids([r for r, number in zip(raw, numbers, strict=True) if number < 0]))
        return [self.words.output(number) if number >= 0 else next(merged) for number in numbers]

    def __call__(self, texts: list[str | None]):
        """For blocks of texts: all ids in order, and where each text's begin (and the last one's end)."""
        merge = self.merge
        special = {i for i, t in enumerate(texts) if t and any(s in t for s in merge.specials)}
        plain = _normal(["" if i in special else t for i, t in enumerate(texts)], merge.library)
        for lo, points, starts, ends, offsets in _words(plain):
            ids, total = self.memo(points, starts, ends)
            cuts = total[np.searchsorted(starts, offsets)]
            odd = unsure(points, offsets)
            apart = [i for i in range(len(offsets) - 1) if lo + i in special or odd[i]]  # the library cuts what it may class otherwise
            if apart:
                parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for i in apart:
                    parts[i] = np.array(self._apart(texts[lo + i]), np.int32)
                ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield ids, cuts

    def _apart(self, text: str) -> list[int]:
        """Ids of a text whose special tokens or rare characters need the library's own cuts; words still come from the lexicon."""
        library, out = self.merge.library, []
        rest = [text]
        for s in self.merge.specials:
            rest = [y for x in rest for y in (self._split(x, s) if isinstance(x, str) else [x])]
        byte = {c: b for b, c in self.merge.letter.items()}
        for part in rest:
            if isinstance(part, int):
                out.append(part)
                continue
            words = [bytes(byte[c] for c in word) for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))]
            out += [i for found in self._found(words) for i in found]
        return out

    def _found(self, raw: list[bytes]) -> list[list[int]]:
        numbers = self.words.find(raw).tolist()
        return [self.words.output(number) if number >= 0 else self.merge.ids(word) for word, number in zip(raw, numbers, strict=True)]

    def _split(self, text: str, special: str) -> list:
        parts = text.split(special)
        out: list = [parts[0]]
        for p in parts[1:]:
            out += [self.merge.specials[special], p]
        return out


_coders: dict[tuple[str, str], Coder] = {}


def transcode(docs: DataFrame, path: str | None = None, digests: bool = False, size: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens and the ids and decoded text of each row; with `digests` their SHA-256 instead.

    Two passes over the texts: word counts of all documents for the lexicon,
    then the encoding, which needs no shuffle. Null and empty texts have no
    ids and decode to an empty text. Texts are read whole; equal rows each
    get a row; other columns are not read; an empty table gives an empty
    lexicon.
    """
    small_batches(docs)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    name = build(docs, path, size)

    def run(batches):
        if (name, path) not in _coders:
            _coders.clear()
            _coders[name, path] = Coder(lexicon(name), merger(path))
        coder = _coders[name, path]
        say, spell = decimals_of(path), tokens_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                at = 0
                for ids, cuts in coder(part.column("text").to_pylist()):
                    n = len(cuts) - 1
                    out = {"doc_id": part.column("doc_id").slice(at, n).cast(pa.int64()), "n_tokens": pa.array(np.diff(cuts), pa.int64())}
                    decoded = spell(ids, cuts)
                    if digests:
                        out |= {k: pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) for k, v in (("ids_sha256", say(ids, cuts)), ("decoded_sha256", decoded))}
                    else:
                        out |= {"ids": list_column(ids, cuts, pa.int32()), "decoded": pa.array([x.decode() for x in decoded], pa.string())}
                    yield pa.RecordBatch.from_pydict(out)
                    at += n

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with `decoded` made from `ids` alone: token strings joined by blanks, unknown ids left out; null ids decode to an empty text."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        spell = tokens_of(path)
        for batch in batches:
            lists = batch.column("ids")
            cuts = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "decoded": pa.array([x.decode() for x in spell(ids, cuts)], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode(table(spark, sf_dir, "documents"), digests=True)
