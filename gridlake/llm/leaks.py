"""Evaluation passages that stand, wholly or partly, in the documents of a corpus."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridlake.llm.words import Words, code_points, gram_hashes, run_hashes, slices
from gridlake.runtime import require

# Characters that scanning confuses, all read as the last of their group.
CONFUSED = ["0o", "1|!il", "5s", "8b", "9gq", "6b", "2z"]
MATCH, MISS, SKIP = 4, -10, -1  # a word alike, a word changed or left out, a word of the document in between
FAR = 40  # words in between cost this at most
SEED = 5  # words of a seed at least
BREAK = re.compile(r"(?<=\w)[-‐\u00ad]\s*\n\s*(?=\w)")  # a hyphen at a line's end


@cache
def folded() -> tuple[np.ndarray, np.ndarray]:
    """(class, reading) by code point; classes: 0 ends a word, 1 belongs to it, 2 is overlooked."""
    kind = np.zeros(0x110000, np.int8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        kind[i] = 1 if c[0] in "LN" else 2 if c in ("Mn", "Me", "Cf") else 0
    reading = np.arange(0x110000, dtype=np.uint32)
    for group in CONFUSED:
        for ch in group:
            reading[ord(ch)] = ord(group[-1])
            kind[ord(ch)] = 1
    return kind, reading


def kinds(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; an exclamation mark is a misread letter only inside a word."""
    k = folded()[0][codes]
    mark = np.flatnonzero(codes == 33)
    if len(mark):
        k[mark] = 0
        beside = np.concatenate([[0], k, [0]])
        k[mark[(beside[mark] == 1) & (beside[mark + 2] == 1)]] = 1
    return k


def folded_words(texts: list[str]) -> Words:
    """Words in a form that layout, case, accents, ligatures, line-end hyphens and misread characters don't change."""
    plain = [BREAK.sub("", t) if "-\n" in t or "-\r" in t or "- " in t or "‐" in t or "\u00ad" in t else t for t in texts]
    codes, first = code_points([unicodedata.normalize("NFKD", t).casefold() for t in plain])
    k = kinds(codes)
    keep = k != 2
    codes, first = folded()[1][codes[keep]], np.concatenate([[0], np.cumsum(keep)])[first]
    inside = k[keep] == 1
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(run_hashes(codes, begin, end - begin), np.searchsorted(begin, first))


class Automaton:
    """Generalised suffix automaton over the words of several passages."""

    def __init__(self, passages: list[np.ndarray]) -> None:
        self.words = np.unique(np.concatenate([*passages, np.zeros(0, np.uint64)]))
        ids = [np.searchsorted(self.words, p) for p in passages]
        gap = 1  # one word that equals nothing stands between passages
        self.text = np.concatenate([np.append(p, [-1 - k] * gap) for k, p in enumerate(ids)]) if ids else np.zeros(0, np.int64)
        self.begin = np.cumsum([0] + [len(p) + gap for p in ids])
        self.size = np.array([len(p) for p in ids], np.int64)
        self.of = np.repeat(np.arange(len(ids)), [len(p) + gap for p in ids])
        nxt: list[dict[int, int]] = [{}]
        link, length, prefix = [-1], [0], []
        last = 0
        for w in self.text.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            prefix.append(cur)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length
        self.met: dict[bytes, list[tuple[int, int, int]]] = {}
        # The state of the last SEED words (of all texts that end like them); every place belongs to one.
        seed = [-1] * len(nxt)
        for s in sorted(range(1, len(nxt)), key=lambda s: length[s]):
            if length[s] >= SEED:
                seed[s] = s if length[link[s]] < SEED else seed[link[s]]
        self.seed = seed
        code, whole = gram_hashes(Words(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.uint64), np.cumsum([0] + [len(p) for p in ids])), SEED)
        self.grams = np.unique(code[whole])
        of_place = np.array(seed, np.int64)[np.array(prefix, np.int64)]
        self.places = np.argsort(of_place, kind="stable")
        self.first = np.searchsorted(of_place[self.places], np.arange(len(nxt) + 1))

    def numbers(self, words: Words) -> np.ndarray:
        """Number of each word among the passages' words, far below 0 for others."""
        if not len(self.words):
            return np.full(len(words.hash), -(1 << 30), np.int32)
        at = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
        return np.where(self.words[at] == words.hash, at, -(1 << 30)).astype(np.int32)

    def ends(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(word of the text, state of its seed, word after) wherever a match of SEED words or more ends at some place of the state."""
        nxt, link, length, seed = self.next, self.link, self.length, self.seed
        s = n = 0
        for i, w in enumerate(words):
            if n >= SEED:
                u = seed[s]
                if w not in nxt[u] or len(nxt[u]) > 1:
                    yield i - 1, u, w
            t = nxt[s].get(w)
            if t is None:
                while t is None and s:
                    s = link[s]
                    t = nxt[s].get(w)
                n = length[s]
                if t is None:
                    n = 0
                    continue
            s = t
            n += 1
        if n >= SEED:
            yield len(words) - 1, seed[s], -(1 << 30)

    def ends_met(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """ends() of a stretch, remembered: stock sentences come again and again."""
        key = words.tobytes()
        got = self.met.get(key)
        if got is None:
            if len(self.met) >= 100_000:
                self.met.clear()
            got = self.met[key] = list(self.ends(words.tolist()))
        return got

    def stretches(self, ids: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) of the stretches whose every SEED words stand in the passages: all that the automaton need read."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        maybe = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED) if len(ids) >= SEED else np.zeros(0, np.int64)
        code, whole = gram_hashes(Words(ids.astype(np.uint64), words.begin), SEED)
        maybe = maybe[whole[maybe]]
        at = np.minimum(np.searchsorted(self.grams, code[maybe]), max(len(self.grams) - 1, 0))
        hit = maybe[self.grams[at] == code[maybe]] if len(self.grams) else maybe[:0]
        begin = np.concatenate([[True], np.diff(hit) != 1]) if len(hit) else np.zeros(0, bool)
        # Neighbouring stretches of two texts aren't joined: the last SEED - 1 words of a text begin none.
        return hit[begin], hit[np.append(begin[1:], True)] + SEED if len(hit) else hit

    def spread(self, where: np.ndarray, state: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``where``, word of the passages): every place of the states at which the passage goes on differently."""
        size = self.first[state + 1] - self.first[state]
        row = np.repeat(np.arange(len(where)), size)
        place = self.places[self.first[state][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
        ends = self.text[place + 1] != after[row]
        return row[ends], place[ends]


def candidates(auto: Automaton, words: Words, ids: np.ndarray, page_break: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, least shift, largest shift) worth aligning; a shift is where in the text the passage would begin.

    17 of some 20 passage words around a seed stand about where they should. Seeds of one passage
    whose shifts follow each other by ``page_break`` words at most are one candidate.
    """
    none = np.zeros(0, np.int64)
    if not len(auto.words) or not len(words.hash):
        return none, none, none, none
    found = [(d + i, u, w if w >= 0 else int(ids[z]) if z < len(ids) else w) for d, z in zip(*(x.tolist() for x in auto.stretches(ids, words)), strict=True) for i, u, w in auto.ends_met(ids[d:z])]
    if not found:
        return none, none, none, none
    ends, state, after = np.array(found, np.int64).T
    texts = np.searchsorted(words.begin, ends, "right") - 1
    width = 20
    # Word numbers as narrow as they fit; words that aren't in any passage equal none of theirs.
    narrow = np.int16 if len(auto.words) < 1 << 15 else np.int32
    padded = np.concatenate([np.full(64, -1), np.maximum(ids, -1), np.full(64, -1)]).astype(narrow)
    passage = np.concatenate([np.full(64, -2), np.maximum(auto.text, -2) - (auto.text < 0), np.full(64, -2)]).astype(narrow)
    around_text, around_passage = np.lib.stride_tricks.sliding_window_view(padded, 71), np.lib.stride_tricks.sliding_window_view(passage, 67)
    kept = []
    # Some 20,000 places at once, or those of one end.
    load = np.cumsum(auto.first[state + 1] - auto.first[state]) // 20_000
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(load)) + 1, [len(ends)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        row, places = auto.spread(ends[a:b], state[a:b], after[a:b])
        for c in range(0, len(row), 20_000):
            r, q = row[c : c + 20_000] + a, places[c : c + 20_000]
            w, p = ends[r] + 64, q + 64
            target, here = around_passage[p - 33], around_text[w - 35]
            near = here[:, 2:69] == target
            for shift in (0, 1, 3, 4):
                near |= here[:, shift : shift + 67] == target
            good = np.count_nonzero(near, axis=1) >= 17
            sums = np.zeros((int(good.sum()), 68), np.int8)
            np.cumsum(near[good], axis=1, dtype=np.int8, out=sums[:, 1:])
            good[good] = (sums[:, width:] - sums[:, :-width]).max(axis=1) >= 17
            kept.append(np.stack([ends[r], q, texts[r]])[:, good])
    where, place, text = np.concatenate([np.zeros((3, 0), np.int64), *kept], axis=1)
    of = auto.of[place]
    shift = where - words.begin[text] - (place - auto.begin[of])
    order = np.lexsort((shift, of, text))
    text, of, shift = text[order], of[order], shift[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (of[1:] != of[:-1]) | (shift[1:] - shift[:-1] > page_break)
    last = np.append(new[1:], True)[: len(new)]
    return text[new], of[new], shift[new], shift[last]


def best_scores(auto: Automaton, words: Words, ids: np.ndarray, text: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The score that align() would give, without what stands where: a fifth of its work."""
    out = np.zeros(len(text), np.int64)
    for pick, rows, cols, doc in _windows(auto, words, ids, text, of, low, high):
        kind = np.int16 if MATCH * rows + cols + FAR < 1 << 14 else np.int32
        j = np.arange(cols + 1, dtype=kind)
        score = np.zeros((len(pick), cols + 1), kind)
        gain = np.array([MISS, MATCH], kind)
        for r in range(rows):
            live = r < auto.size[of[pick]]
            word = auto.text[np.minimum(auto.begin[of[pick]] + r, len(auto.text) - 1)].astype(np.int32)
            new = np.maximum(score + kind(MISS), 0)
            np.maximum(new[:, 1:], score[:, :-1] + gain[(doc == word[:, None]).view(np.int8)], out=new[:, 1:])
            score = np.maximum(np.maximum.accumulate(new - kind(SKIP) * j, axis=1) + kind(SKIP) * j, np.maximum.accumulate(new, axis=1) - kind(FAR))
            out[pick] = np.maximum(out[pick], np.where(live, new.max(axis=1), 0))
    return out


def _windows(auto: Automaton, words: Words, ids: np.ndarray, text: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(candidates, words of their longest passage, columns, word numbers of the text in each column), as many at once as two million cells hold."""
    if not len(text):
        return
    ids = np.append(ids, np.int32(-(1 << 30)))
    columns = auto.size[of] + 96 + high - low
    order = np.lexsort((columns, auto.size[of]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 512 and (b - a + 1) * columns[order[a : b + 1]].max() <= 2_000_000:
            b += 1
        pick = order[a:b]
        a = b
        cols = int(columns[pick].max())
        doc_at = low[pick, None] - 24 + np.arange(cols) + words.begin[text[pick], None]
        inside = (doc_at >= words.begin[text[pick], None]) & (doc_at < words.begin[text[pick] + 1, None])
        yield pick, int(auto.size[of[pick]].max()), cols, np.where(inside, ids[np.clip(doc_at, 0, len(ids) - 1)], -(1 << 30)).astype(np.int32)


def align(auto: Automaton, words: Words, ids: np.ndarray, text: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Best local alignment of each passage near its places in a text: rows (score, passage words spanned, words alike, first word of the text, last).

    Words of the text in between cost SKIP each and FAR at most, so a page break of any length
    costs the same; other changes cost MISS.
    """
    out = np.zeros((len(text), 5), np.int64)
    for pick, rows, cols, doc in _windows(auto, words, ids, text, of, low, high):
        shift = (cols + 1).bit_length()
        mask = (1 << shift) - 1
        wide = np.int32 if (MATCH * rows + 2 * cols + FAR + 2) << shift < 1 << 31 else np.int64
        j = np.arange(cols + 1, dtype=wide)
        i = np.arange(len(pick))
        score = np.zeros((len(pick), cols + 1), np.int32)
        origin = np.zeros(score.shape, wide)  # passage word and column where the alignment begins
        alike = np.zeros_like(score)
        best = np.zeros((len(pick), 5), np.int64)
        for r in range(rows):
            live = r < auto.size[of[pick]]
            word = auto.text[np.minimum(auto.begin[of[pick]] + r, len(auto.text) - 1)].astype(np.int32)
            same = doc == word[:, None]
            diagonal = score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISS))
            new, new_origin, new_alike = score + np.int32(MISS), origin.copy(), alike.copy()
            take = diagonal >= new[:, 1:]
            fresh = score[:, :-1] == 0
            new[:, 1:] = np.where(take, diagonal, new[:, 1:])
            new_origin[:, 1:] = np.where(take, np.where(fresh, wide(r << shift) + j[:-1], origin[:, :-1]), new_origin[:, 1:])
            new_alike[:, 1:] = np.where(take, np.where(fresh, np.int32(0), alike[:, :-1]) + same, new_alike[:, 1:])
            new = np.maximum(new, 0)
            # Value and place of the best to the left in one number each: near ones by distance, far ones at FAR.
            near = np.maximum.accumulate(((new - SKIP * j) << shift) + j, axis=1)
            far = np.maximum.accumulate((new.astype(wide) << shift) + j, axis=1)
            by_near, by_far = (near >> shift) + SKIP * j, (far >> shift) - FAR
            over = np.maximum(by_near, by_far)
            better = over > new
            if better.any():
                from_ = np.where(by_near >= by_far, near, far) & mask
                new = np.where(better, over, new).astype(np.int32)
                new_origin = np.where(better, np.take_along_axis(new_origin, from_, 1), new_origin)
                new_alike = np.where(better, np.take_along_axis(new_alike, from_, 1), new_alike)
            score, origin, alike = new, new_origin, new_alike
            top = score.argmax(axis=1)
            more = live & (score[i, top] > best[:, 0])
            if more.any():
                o = origin[i, top]
                best[more] = np.stack([score[i, top], r - (o >> shift) + 1, alike[i, top], o & mask, top - 1], axis=1)[more]
        best[:, 3:] += low[pick, None] - 24
        out[pick] = best
    return out


def _blocks(items: DataFrame, item_id: str, passage: str, block_words: int) -> Iterator[tuple[list[np.ndarray], list[list]]]:
    """(passages, the items of each) in blocks of ``block_words``; equal passages are one, whatever their layout."""
    by_passage: dict[bytes, list] = {}
    for r in items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(item_id, passage).toLocalIterator():
        words = folded_words([r[1]]).hash
        if len(words):
            by_passage.setdefault(words.tobytes(), []).append(r[0])
    passages, names, total = [], [], 0
    for key, ids in by_passage.items():
        if total and total + len(key) // 8 > block_words:
            yield passages, names
            passages, names, total = [], [], 0
        passages.append(np.frombuffer(key, np.uint64))
        names.append(ids)
        total += len(key) // 8
    if passages:
        yield passages, names


def _per_text(rows: DataFrame, passages: list[np.ndarray], names: list[list], limits: tuple, schema: str, make: Callable) -> DataFrame:
    """``make`` (texts, ids, leaks_in() of them, names) of slices of the rows (id, text); a block of passages is broadcast once."""
    sent, mark = rows.sparkSession.sparkContext.broadcast((passages, names)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, names = sent.value
        auto = _automaton(mark, passages)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                part = [t or "" for t in texts[a:b]]
                out = make(batch.slice(a, b - a), part, leaks_in(auto, part, *limits), names)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    running: int = 30,
    score: float = 3.2,
    page_break: int = 200,
    block_words: int = 2_000_000,
) -> DataFrame:
    """(id_column, item_id, words, alike, coverage): the documents that hold a passage or ``running`` words of it.

    The items are a suffix automaton over folded words. Stretches of a document whose every SEED
    words stand in the items stream through it; at every place of the items a match of SEED words
    or more opens a candidate where it ends, if 17 of 20 words around it agree. A candidate is
    aligned: words changed or left out and page breaks of up to ``page_break`` words in between are
    allowed for. It is a leak if the aligned part spans at least ``running`` words of the passage
    (or all of a shorter passage) and scores at least ``score`` for each of these: MATCH for a word
    alike, MISS for one changed or left out. Two formulaic sentences that happen to follow each
    other score less. Items with the same passage are all reported; coverage is the share of the
    passage that the aligned part spans.

    Passages and texts may have any length and any number of passages may be alike. The items come
    to the driver as word hashes and are broadcast in blocks of ``block_words`` (16 MB); test sets
    are small, and more than one block only makes more passes. NULL or empty texts and passages
    match nothing. Rows with the same ids are rows of their own; equal (document, item) pairs of
    one row come once.
    """
    require(docs, id_column, text)
    require(items, item_id, passage)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_id].dataType
    item_arrow = to_arrow_type(item_kind)

    def make(batch: pa.RecordBatch, texts: list[str], leaks: list[Leak], names: list[list]) -> pa.RecordBatch | None:
        flat = [(x, n) for x in leaks for n in names[x.passage]]
        if not flat:
            return None
        at = pa.array([x.text for x, _ in flat])
        columns = [batch.column("id").take(at), pa.array([n for _, n in flat], item_arrow), pa.array([x.words for x, _ in flat], pa.int32()), pa.array([x.alike for x, _ in flat], pa.int32()), pa.array([x.coverage for x, _ in flat])]
        return pa.RecordBatch.from_arrays(columns, ["id", "item", "words", "alike", "coverage"])

    schema = f"id {kind}, item {item_kind.simpleString()}, words int, alike int, coverage double"
    out = rows.sparkSession.createDataFrame([], schema)
    for k, (passages, names) in enumerate(_blocks(items, item_id, passage, block_words)):
        part = _per_text(rows, passages, names, (running, score, page_break), schema, make)
        out = out.unionByName(part) if k else part
    return out.select(F.col("id").alias(id_column), F.col("item").alias(item_id), "words", "alike", "coverage")


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    running: int = 30,
    coverage: float = 1.0,
    score: float = 3.2,
    page_break: int = 200,
    block_words: int = 2_000_000,
) -> DataFrame:
    """(id_column, text, spans, removed_words): every row with the leaked spans cut out of its text.

    A span is what find_leaks() aligned; it is cut if it spans at least ``running`` words of the
    passage or the share ``coverage`` of it. Overlapping spans are one. A line feed stands for each.
    Texts without leak come as they are, NULL as NULL, with no spans.
    """
    require(docs, id_column, text)
    require(items, item_id, passage)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, text string, spans int, removed int"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.lit(0).alias("spans"), F.lit(0).alias("removed"))

    def make(batch: pa.RecordBatch, texts: list[str], leaks: list[Leak], names: list[list]) -> pa.RecordBatch:
        clean, spans, removed = (batch.column(c).to_pylist() for c in ("text", "spans", "removed"))
        cuts: dict[int, list[tuple[int, int]]] = {}
        for x in leaks:
            if x.words >= running or x.coverage >= coverage:
                cuts.setdefault(x.text, []).append((x.first, x.last))
        for d, found in cuts.items():
            begin, end = word_places(texts[d])
            merged: list[list[int]] = []
            for a, z in sorted(found):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            keep, at = [], 0
            for a, z in merged:
                keep.append(texts[d][at : begin[a]])
                at = end[z]
            clean[d] = "\n".join([*keep, texts[d][at:]])
            spans[d] += len(merged)
            removed[d] += sum(z - a + 1 for a, z in merged)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(clean, pa.string()), pa.array(spans, pa.int32()), pa.array(removed, pa.int32())], ["id", "text", "spans", "removed"])

    for passages, names in _blocks(items, item_id, passage, block_words):
        rows = _per_text(rows, passages, names, (running, score, page_break, True), schema, make)
    return rows.select(F.col("id").alias(id_column), F.col("text").alias(text), "spans", F.col("removed").alias("removed_words"))


def word_places(text: str) -> tuple[list[int], list[int]]:
    """Where the folded words of a text begin and end in it, in code points."""
    dropped = np.zeros(len(text), bool)
    for m in BREAK.finditer(text):
        dropped[m.start() : m.end()] = True
    forms = {c: unicodedata.normalize("NFKD", c).casefold() for c in set(text)}
    owner, folded_text = [], []
    for i, c in enumerate(text):
        if not dropped[i]:
            folded_text.append(forms[c])
            owner += [i] * len(forms[c])
    codes = np.frombuffer("".join(folded_text).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds(codes)
    at = np.array(owner, np.int64)[k != 2]
    edge = np.diff(np.concatenate([[0], (k[k != 2] == 1).view(np.int8), [0]]))
    return at[np.flatnonzero(edge == 1)].tolist(), (at[np.flatnonzero(edge == -1) - 1] + 1).tolist()


@dataclass(frozen=True)
class Leak:
    text: int
    passage: int
    words: int  # of the passage, spanned by the aligned part
    alike: int
    coverage: float
    first: int  # words of the text
    last: int


def leaks_in(auto: Automaton, texts: list[str], running: int, score: float, page_break: int, every: bool = False) -> list[Leak]:
    """The texts' leaks: the best of each text and passage; with ``every`` all places, found by blanking those found and looking again."""
    words = folded_words(texts)
    out: list[Leak] = []
    names = np.arange(len(texts))
    while True:
        ids = auto.numbers(words)
        found = candidates(auto, words, ids, page_break)
        need = np.minimum(running, auto.size[found[1]])
        high_enough = best_scores(auto, words, ids, *found) >= score * need
        text, of, low, high = (x[high_enough] for x in found)
        got, need = align(auto, words, ids, text, of, low, high), need[high_enough]
        leak = (got[:, 1] >= need) & (got[:, 0] >= score * need)
        best: dict[tuple[int, int], Leak] = {}
        for t, p, (_, w, s, a, z) in zip(text[leak].tolist(), of[leak].tolist(), got[leak].tolist(), strict=True):
            if (t, p) not in best or (best[t, p].words, best[t, p].alike) < (w, s):
                best[t, p] = Leak(t, p, w, s, w / int(auto.size[p]), a, z)
        out += [replace(x, text=int(names[x.text])) for x in best.values()]
        if not every or not best:
            return out
        for x in best.values():
            words.hash[words.begin[x.text] + x.first : words.begin[x.text] + x.last + 1] = 0
        again = np.unique([x.text for x in best.values()])
        hashes = [words.hash[words.begin[t] : words.begin[t + 1]] for t in again]
        words, names = Words(np.concatenate(hashes), np.cumsum([0] + [len(h) for h in hashes])), names[again]


_BUILT: dict[str, Automaton] = {}


def _automaton(mark: str, passages: list[np.ndarray]) -> Automaton:
    """Built once per worker process."""
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Automaton(passages)
    return _BUILT[mark]
