"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Pre-tokens are cut with array operations over character classes. The corpus's frequent ones are
compiled into a minimal acyclic automaton whose edges carry word counts, so that a path spells a
word and sums to the word's number, under which its ids are kept. The automaton is a file of flat
arrays that Spark hands to every executor, where the workers map it into memory. Words it doesn't
hold are merged by the vocabulary's ranks, so results never depend on the lexicon.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.words import code_points, run_hashes, slices
from gridlake.runtime import require, share_file

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# What may follow an apostrophe as a pre-token of its own.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    points = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\x00" for i in range(0x110000))
    out = np.full(len(points), OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, begin, size, first): pre-tokens codes[begin : begin + size]; text d has first[d] to first[d + 1]."""
    codes, at = code_points(texts)
    n = len(codes)
    kind = classes()[codes].astype(np.int8)
    ends = at[1:] - 1  # the line feeds between texts, which belong to none
    kind[ends] = 9
    if n == len(texts):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    start = new.copy()
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, n))
    # White space before something: its last character stands alone or, if a blank, opens the next word.
    gap = (kind[run] == SPACE) & (np.append(kind, 9)[run + size] != 9)
    last = run[gap] + size[gap] - 1
    start[last] = True
    joins = last[codes[last] == 32] + 1
    start[joins] = False
    # An apostrophe that opens a word, alone before letters, takes these endings with it.
    quote = run[(size == 1) & (codes[run] == 39)]
    quote = quote[start[quote]]
    nxt = lambda k: np.where(quote + k < n, codes[np.minimum(quote + k, n - 1)], 0)
    letter = lambda k: kind[np.minimum(quote + k, n - 1)] == LETTER
    for ending in CONTRACTIONS:
        hit = np.ones(len(quote), bool)
        for k, c in enumerate(ending, 1):
            hit &= (nxt(k) == ord(c)) & letter(k)
        q = quote[hit]
        start[q + 1] = False
        start[q + 1 + len(ending)] = True
    start[ends] = False
    begin = np.flatnonzero(start)
    stop = np.append(begin, n)[1:]
    # A word never reaches the line feed after its text.
    text_end = ends[np.searchsorted(ends, begin)]
    return codes, begin, np.minimum(stop, text_end) - begin, np.searchsorted(begin, at)


class Merger:
    """Exact byte-pair merges by the ranks of a vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text())["model"]
        self.ids = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.symbol = {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token. Pairs are merged in the order of their ranks, a heap finds the next."""
        import heapq

        parts: list[str | None] = [self.symbol[b] for b in word.encode("utf-8", "replace")]
        n = len(parts)
        if n == 1:
            return [self.ids[parts[0]]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.rank.get((a + b, parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := self.rank.get((parts[before[i]], a + b))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [self.ids[p] for p in parts if p is not None]


def build_automaton(words: list[str]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct words: states with sorted edges (label, target, words before)."""
    words = sorted(set(words), key=lambda w: [ord(c) for c in w])
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # frozen: (final, ((label, target), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (k := register.get(key)) is None:
            k = register[key] = len(states)
            states.append(key)
        return k

    path: list[list] = [[False, []]]
    last = ""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((ord(last[len(path) - 1]), freeze(node)))
        for _ in w[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((ord(last[len(path) - 1]), freeze(node)))
    root = freeze(path[0])
    number = np.zeros(len(states), np.int64)
    for k, (final, edges) in enumerate(states):  # targets are frozen before their sources
        number[k] = final + sum(number[t] for _, t in edges)
    first, label, target, skip = [0], [], [], []
    for final, edges in states:
        seen = int(final)
        for c, t in edges:
            label.append(c)
            target.append(t)
            skip.append(seen)
            seen += int(number[t])
        first.append(len(label))
    source = np.repeat(np.arange(len(states)), np.diff(first))
    return {
        "key": source.astype(np.int64) * 0x110000 + np.array(label, np.int64),  # sorted: by state, then label
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in states], bool),
        "root": np.array([root], np.int64),
    }


def look_up(auto: dict[str, np.ndarray], codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Number of each word in the automaton's order, -1 where it doesn't hold it; all words step together."""
    state = np.full(len(begin), auto["root"][0], np.int64)
    number = np.zeros(len(begin), np.int64)
    alive = np.arange(len(begin))
    for k in range(int(size.max()) if len(size) else 0):
        if not len(auto["key"]):
            state[:] = -1
            break
        alive = alive[size[alive] > k]
        if not len(alive):
            break
        want = state[alive] * 0x110000 + codes[begin[alive] + k]
        e = np.minimum(np.searchsorted(auto["key"], want), len(auto["key"]) - 1)
        hit = auto["key"][e] == want
        number[alive[hit]] += auto["skip"][e[hit]]
        state[alive[hit]] = auto["target"][e[hit]]
        state[alive[~hit]] = -1
        alive = alive[hit]
    ok = state >= 0
    ok[ok] = auto["final"][state[ok]]
    return np.where(ok, number, -1)


def frequent_words(df: DataFrame, text: str, least: int, most: int) -> list[str]:
    """The most frequent pre-tokens of all rows; at most ``most`` come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, list] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                codes, begin, size, _ = cut_words(texts[a:b])
                keys, where, n = np.unique(run_hashes(codes, begin, size), return_index=True, return_counts=True)
                for h, i, c in zip(keys.tolist(), where.tolist(), n.tolist(), strict=True):
                    if (seen := count.get(h)) is not None:
                        seen[1] += c
                    else:
                        count[h] = [_spell(codes, begin[i], size[i]), c]
                if len(count) > 200_000:
                    yield _counted(count)
                    count = {}
        yield _counted(count)

    words = df.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Collected as one row: a limit that ends the plan would send as many words of every partition to the driver.
    return words.orderBy(F.desc("n"), "word").limit(most).agg(F.collect_list("word")).first()[0]


def _spell(codes: np.ndarray, begin: int, size: int) -> str:
    return codes[begin : begin + size].tobytes().decode("utf-32-le", "surrogatepass")


def _counted(count: dict[int, list]) -> pa.RecordBatch:
    pairs = list(count.values())
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["word", "n"])


def compile_lexicon(df: DataFrame, text: str, vocabulary: str, least: int, most: int) -> str:
    """Hand the automaton and the ids of its words to all executors as a file; returns its name."""
    words = frequent_words(df, text, least, most)
    merger = Merger(vocabulary)
    auto = build_automaton(words)
    ordered = sorted(set(words), key=lambda w: [ord(c) for c in w])
    ids = [merger.encode(w) for w in ordered]
    auto["ids"] = np.array([i for x in ids for i in x], np.int32)
    auto["ids_begin"] = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in auto.items()}).encode()
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in auto.values())
    return share_file(df.sparkSession, "lexicon", len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8) + body)


def open_lexicon(name: str) -> dict[str, np.ndarray]:
    raw = np.memmap(SparkFiles.get(name), np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size + -size % 8, {}
    for k, (kind, n) in json.loads(raw[8 : 8 + size].tobytes()).items():
        long = np.dtype(kind).itemsize * n
        out[k] = raw[at : at + long].view(kind)
        at += long + -long % 8
    return out


class Encoder:
    """Encodes slices of texts; keeps the ids of the words it has met, by hash, in sorted arrays."""

    KEEP = 500_000  # words remembered by a worker before it starts afresh

    def __init__(self, lexicon: dict[str, np.ndarray], vocabulary: str) -> None:
        self.lexicon, self.vocabulary, self.merger = lexicon, vocabulary, None
        self.forget()

    def forget(self) -> None:
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        number = look_up(self.lexicon, codes, begin, size)
        lo = self.lexicon["ids_begin"]
        known = np.flatnonzero(number >= 0)
        start, count = lo[number[known]], lo[number[known] + 1] - lo[number[known]]
        where = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pieces, counts = [np.asarray(self.lexicon["ids"][where])], np.zeros(len(keys), np.int64)
        counts[known] = count
        rest = np.flatnonzero(number < 0)
        if len(rest):
            self.merger = self.merger or Merger(self.vocabulary)
            for k in rest:
                got = self.merger.encode(_spell(codes, begin[k], size[k]))
                counts[k] = len(got)
                pieces.append(np.array(got, np.int32))
        order = np.concatenate([known, rest])
        at = np.zeros(len(keys), np.int64)
        at[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *pieces])
        h = np.concatenate([self.hash, keys])
        by = np.argsort(h, kind="stable")
        self.hash, self.begin, self.size = h[by], np.concatenate([self.begin, at])[by], np.concatenate([self.size, counts])[by]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        codes, begin, size, first = cut_words(texts)
        keys, where, inverse = np.unique(run_hashes(codes, begin, size), return_index=True, return_inverse=True)
        if len(self.hash) > self.KEEP:
            self.forget()
        e = np.minimum(np.searchsorted(self.hash, keys), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[e] != keys) if len(self.hash) else np.arange(len(keys))
        if len(new):
            self.learn(keys[new], codes, begin[where[new]], size[where[new]])
            e = np.searchsorted(self.hash, keys)
        count, start = self.size[e][inverse], self.begin[e][inverse]
        upto = np.cumsum(count)
        at = np.repeat(start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
        return self.ids[at], np.concatenate([[0], upto])[first]


def encode_corpus(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", least: int = 3, most: int = 60_000) -> DataFrame:
    """(id, ids): the ids of every row's text, without special tokens; NULL and empty texts give an empty list.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can read. Pre-tokens are
    counted over all rows; ``least`` and ``most`` bound the frequency and number of those that the
    lexicon holds, which changes the speed only.
    """
    require(df, id_column, text)
    folder = compile_lexicon(df, text, vocabulary, least, most)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(open_lexicon(folder), vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                ids, offsets = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], lists], ["id", "ids"])

    return df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
