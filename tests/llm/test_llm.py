"""The llm operators against brute force, round trips and edge cases."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import leaks as lk
from gridlake.llm import repetition as rp
from gridlake.llm import tokens as tk
from gridlake.llm.clusters import cluster_curves, condense, describe_clusters, kruskal, neighbours, pairs_together, shapes
from gridlake.llm.percentiles import merge_counts, percentiles, value_counts
from gridlake.llm.words import words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(np.round(rng.normal(), 1)) + 0.0, i % 5) for i in range(3000)]
    rows += [("hot", None, 1), ("hot", float("nan"), 1), (None, 2.0, 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, day int")
    points = [0.05, 0.5, 0.951]
    one = percentiles(value_counts(df, {"g": F.col("g")}, F.col("v")), ["g"], points)
    merged = percentiles(merge_counts(value_counts(df, {"g": F.col("g"), "day": F.col("day")}, F.col("v")), ["g"]), ["g"], points)
    for got in (one, merged):
        got = {r[0]: r[1:] for r in got.collect()}
        assert set(got) == {r[0] for r in rows if r[1] == r[1] and r[1] is not None}
        for g, (n, *ps) in got.items():
            v = [r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
            assert n == len(v) and np.allclose(ps, np.percentile(v, [100 * p for p in points]))
    assert percentiles(value_counts(df.limit(0), {"g": F.col("g")}, F.col("v")), ["g"], points).count() == 0


def brute_repeated(text, n=5):
    words = re.findall(r"[^\W\d_]+", text.lower())
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    return len(words), sum(hit)


def test_repetition_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n ", "123 456", "a b c d", "one two three four five " * 3, "Wort " * 50, "ÀÉ x1y_z " * 9]
    texts += [" ".join(rnd.choice(["alpha", "beta", "Gamma,", "δ.", "e5"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([(i % 40, t, "h" if i % 2 else None, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, words string")
    got = sorted((r.doc_id, r.words, r.repeated) for r in rp.repetition_report(df).collect())
    assert got == sorted((i % 40, *brute_repeated(t or "")) for i, t in enumerate(texts))
    assert rp.repetition_report(df.limit(0)).count() == 0


def test_repetition_of_a_very_long_text(spark):
    text = " ".join(f"w{string.ascii_lowercase[i % 26]}{string.ascii_lowercase[i // 26 % 26]}{string.ascii_lowercase[i // 676 % 26]}" for i in range(17576)) * 40
    got = rp.repetition_report(spark.createDataFrame([(1, text, "h")], "doc_id bigint, text string, source string")).first()
    assert got.repetitive and abs(got.share - 39 / 40) < 1e-3


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def texts_for_tokens():
    rnd = random.Random(7)
    pool = ["'s", "'re", "'x", " ", "  ", "\n", "\t", "\r\n", "word", "Don't", "ÄÖ", "ﬁ", "漢字", "🙂", "é", "123", "½", "...", "--", "_", " ", " ", "<|endoftext|>", "'", "''", " 'll", "​", "I've", "x'd've"]
    return ["", " ", "\n\n", "  a", "a  ", "'s", " 's", "a's b 's", "''s", "퟿"] + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]


@pytest.mark.parametrize("most", [0, 50, 60_000])
def test_tokens_equal_the_library(spark, most):
    texts = [None, *texts_for_tokens()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tk.encode_corpus(df, VOCABULARY, least=1, most=most).collect()}
    want = tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [got[i] for i in range(len(texts))] == [w.ids for w in want]


def test_lexicon_counts_every_row(spark, monkeypatch):
    names, compile_lexicon = [], tk.compile_lexicon
    monkeypatch.setattr(tk, "compile_lexicon", lambda *a: names.append(compile_lexicon(*a)) or names[-1])
    # 10,000 words in three rows each, 12,500 in two: a count over fewer rows misses words or takes others.
    spell = "translate(cast({} AS string), '0123456789', 'abcdefghij')"
    df = spark.range(55_000).selectExpr("id AS doc_id", f"CASE WHEN id < 30000 THEN {spell.format('id div 3')} ELSE 'x' || {spell.format('id div 2')} END AS text")
    tk.encode_corpus(df, VOCABULARY)
    often, seldom = ([r.text for r in df.where(c).select("text").distinct().collect()] for c in ("doc_id < 30000", "doc_id >= 30000"))
    auto = tk.open_lexicon(names[0])
    size = np.array([len(w) for w in often + seldom])
    codes = np.frombuffer("".join(often + seldom).encode("utf-32-le"), np.uint32)
    held = tk.look_up(auto, codes, np.cumsum(size) - size, size) >= 0
    assert len(often) == 10_000 and held[:10_000].all() and not held[10_000:].any()
    assert len(auto["ids_begin"]) == 10_001


def test_automaton_numbers_words():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 7))) for _ in range(300)})
    auto = tk.build_automaton(words)
    codes, begin, size, _ = tk.cut_words([])
    all_ = [*words, "zzz", "abcabcabc", "é" * 9]
    text = "".join(all_)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in all_])
    got = tk.look_up(auto, codes, np.cumsum(size) - size, size).tolist()
    assert got[: len(words)] == list(range(len(words))) and got[len(words) :] == [words.index(w) if w in words else -1 for w in all_[len(words) :]]
    assert len(auto["final"]) < sum(map(len, words))  # suffixes are shared


def test_merges_of_a_long_word():
    m = tk.Merger(VOCABULARY)
    for w in ("a" * 5000, "xyz" * 700, " internationalisation"):
        assert m.encode(w) == tokenizer().encode(w, add_special_tokens=False).ids


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "ve") for b in ("ra", "ne", "so", "di") for c in ("st", "m", "l", "th", "x")]


def passage(seed, n=60):
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) for _ in range(n)]


def test_leaks(spark):
    p, q = passage(1), passage(2)
    filler = lambda s, n: " ".join(passage(s, n))
    noisy = [w.upper() if i % 3 else w for i, w in enumerate(p[:36])]
    noisy[7], noisy[15] = "XXXX", "k0" + noisy[15]
    noisy[20:21] = ["tu-\nrast"] if p[20] == "turast" else [noisy[20]]
    del noisy[28]
    docs = {
        1: filler(50, 100) + " " + " ".join(p) + " " + filler(51, 50),
        2: filler(52, 100) + ", ".join(noisy) + ". " + filler(53, 80),
        3: filler(54, 30) + " " + " ".join(p[:20]) + " " + filler(55, 30),  # a shorter quotation
        4: filler(56, 300),
        5: " ".join(q[10:26]) + "\n\n— page 12 of 40 —\nHigh Court\n\n" + " ".join(q[26:45]),
        6: None, 7: "", 8: filler(57, 40) + " " + "  ".join(f"{w}́" for w in p[5:50]),
    }
    items = [(10, " ".join(p)), (11, " ".join(p).title()), (12, " ".join(q)), (13, None), (14, ""), (15, "Two words.")]
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    want = {(1, 10), (1, 11), (2, 10), (2, 11), (5, 12), (8, 10), (8, 11)}
    for block in (2_000_000, 50):
        assert {(r.doc_id, r.item_id) for r in lk.find_leaks(df, it, block_words=block).collect()} == want
    assert lk.find_leaks(df.limit(0), it).count() == 0 and lk.find_leaks(df, it.limit(0)).count() == 0


def test_leaks_of_a_run_that_many_passages_share(spark):
    """Versions of a passage and overlapping windows of one text: a document with the run leaks all of them."""
    run, source = passage(1, 32), passage(2, 90)
    items = [(i, " ".join([*passage(100 + i, 20), *run, *passage(200 + i, 20)])) for i in range(12)]
    items += [(50 + i, " ".join(source[3 * i : 3 * i + 45])) for i in range(15)]
    changed = [w if k % 13 != 7 else "other" for k, w in enumerate(run)]
    docs = [(1, " ".join([*passage(60, 50), *run, *passage(61, 50)])), (2, " ".join(source)), (3, " ".join([*passage(62, 50), *changed, *passage(63, 50)]))]
    got = {(r.doc_id, r.item_id) for r in lk.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"), running=28).collect()}
    assert {d for d, _ in got} >= {1, 2} and {i for d, i in got if d == 1} == set(range(12)) and {i for d, i in got if d == 2} == set(range(50, 65))
    assert len({i for d, i in got if d == 3}) in (0, 12)  # judged by the alignment alone, alike for all


@pytest.mark.parametrize("n", [9, 12, 30])
def test_leaks_of_passages_nearly_alike(spark, n):
    base = passage(7, 70)
    items = [(i, " ".join([*base[:35], f"only{i}", *base[36:]])) for i in range(n)]
    got = lk.find_leaks(spark.createDataFrame([(1, " ".join([*passage(60, 80), *base, *passage(61, 80)]))], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert {r.item_id for r in got.collect()} == set(range(n))


def test_leaks_of_very_long_passages_and_page_breaks(spark):
    long, p = passage(8, 6000), passage(9, 40)
    docs = [(1, " ".join([*passage(60, 50), *long, *passage(61, 50)]))]
    docs += [(2 + k, " ".join([*passage(62, 50), *p[:20], *passage(70 + k, gap), *p[20:], *passage(63, 50)])) for k, gap in enumerate((40, 80, 150, 400))]
    items = spark.createDataFrame([(10, " ".join(long)), (11, " ".join(p))], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id): r for r in lk.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert set(got) == {(1, 10), (2, 11), (3, 11), (4, 11)} and got[1, 10].words == 6000 and got[1, 10].coverage == 1


def test_leaked_spans_are_removed(spark):
    p = passage(1)
    shown = "ﬁn— " + " ".join(passage(50, 20)) + ". "
    body = ", ".join(w.upper() for w in p[:30]) + " tu-\nrast" + " " + " ".join(p[30:])
    docs = [(1, shown + body + "; " + shown + body + "!"), (2, shown), (3, None), (4, "")]
    for block in (2_000_000, 50):
        got = {r.doc_id: r for r in lk.remove_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(p)), (8, " ".join(passage(2)))], "item_id bigint, passage string"), block_words=block).collect()}
        assert got[1].text == shown + "\n; " + shown + "\n!" and (got[1].spans, got[1].removed_words) == (2, 122)
        assert [(got[i].text, got[i].spans) for i in (2, 3, 4)] == [(shown, 0), (None, 0), ("", 0)]


def test_stretches_and_ends_equal_a_walk_over_all_words():
    rnd = random.Random(3)
    passages = [words_of([" ".join(rnd.choice(WORDS[:6]) for _ in range(40))]).hash for _ in range(5)]
    auto = lk.Automaton(passages)
    words = words_of([" ".join(rnd.choice(WORDS[:7]) for _ in range(rnd.randrange(0, 90))) for _ in range(20)])
    ids = auto.numbers(words)
    every = [(a + i, u) for a, z in zip(words.begin[:-1], words.begin[1:], strict=True) for i, u, _ in auto.ends(ids[a:z].tolist())]
    some = [(a + i, u) for a, z in zip(*auto.stretches(ids, words), strict=True) for i, u, _ in auto.ends(ids[a:z].tolist())]
    assert every and every == some


def curve_rows(kinds=4, each=60, odd=5, seed=0):
    rng, rows, truth = np.random.default_rng(seed), [], {}
    base = [1 + 0.8 * np.exp(-0.5 * ((np.arange(24) - 3 - 5 * k) / 2) ** 2) * (1 + k % 2) for k in range(kinds)]
    for k in range(kinds):
        for _ in range(each):
            i = len(rows) + 1
            q = [float(v) for v in base[k] * 10 ** rng.uniform(-1, 3) * (1 + 0.03 * rng.normal(size=24))]
            if i % 29 == 0:
                q[int(rng.integers(24))] = None
            if i % 31 == 0:
                q = q[:2] + q[3:]
            rows.append((i, q))
            truth[i] = k
    for _ in range(odd):
        rows.append((len(rows) + 1, [float(v) for v in rng.uniform(0.1, 6, 24)]))
    rows.append((len(rows) + 1, rows[0][1]))
    truth[len(rows)] = 0
    rows += [(len(rows) + 1, None), (len(rows) + 2, []), (len(rows) + 3, [0.0] * 24), (len(rows) + 4, [None] * 24)]
    return rows, truth


@pytest.mark.parametrize("limits", [{}, {"tree_limit": 200, "hierarchy_limit": 80}])
def test_clusters(spark, limits):
    rows, truth = curve_rows()
    members = cluster_curves(spark.createDataFrame(rows, "curve_id bigint, qe array<double>"), **limits)
    got = {r.curve_id: r.cluster for r in members.collect()}
    assert len(got) == len(rows)
    by = {}
    for i, k in truth.items():
        by.setdefault(k, set()).add(got[i])
    assert all(len(v) == 1 and None not in v for v in by.values()) and len({next(iter(v)) for v in by.values()}) == 4
    assert all(got[i] is None for i, _ in rows if i not in truth)
    if not limits:
        d = {r.cluster: (r["size"], r.exemplars) for r in describe_clusters(members).collect()}
        assert sorted(n for n, _ in d.values()) == [60, 60, 60, 61] and all(got[e] == c for c, (_, es) in d.items() for e in es)
        pairs = spark.createDataFrame([(1, 2, 1), (2, 70, 3), (3, len(rows), 1)], "pair_id bigint, curve_a bigint, curve_b bigint")
        assert [tuple(r) for r in pairs_together(pairs, members).collect()] == [(1, 2)]


def test_neighbour_recall(spark):
    """One dense kind with more rows than a block is compared with, cut by several tasks."""
    rng = np.random.default_rng(2)
    x = (1 + 0.08 * rng.normal(size=(14_000, 24))).astype(np.float32)
    near = neighbours(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node bigint, shape array<float>"), 6, 3, 0.3, 7)
    got = {}
    for r in near.collect():
        got.setdefault(r.node, set()).update(e.to for e in r.near)
    ask = rng.choice(len(x), 400, replace=False)
    d = ((x[ask][:, None] - x[None, :7000]) ** 2).sum(2), ((x[ask][:, None] - x[None, 7000:]) ** 2).sum(2)
    d = np.concatenate(d, axis=1)
    d[np.arange(len(ask)), ask] = np.inf
    true = np.argsort(d, axis=1)[:, :6]
    assert np.mean([len(set(t) & got[a]) / 6 for a, t in zip(ask.tolist(), true.tolist(), strict=True)]) >= 0.9


@pytest.mark.parametrize("noise, least", [([0.1, 0.14], 1), ([0.06, 0.12], 5)])
def test_clusters_in_bands(spark, noise, least):
    """Kinds that split just above merge_below: the clusters don't depend on the number of tasks."""
    rng, hour = np.random.default_rng(0), 2 * np.pi * np.arange(24) / 24
    rows = [(i, [float(v) for v in 1 + 0.3 * (1 + 0.3 * (i % 2)) * np.cos((1 + i % 5) * hour) + rng.choice(noise) * rng.normal(size=24)]) for i in range(450)]
    rows += [(450 + i, rows[i // 4][1]) for i in range(20)]  # copies, heavier than `least`
    df = spark.createDataFrame(rows, "curve_id bigint, qe array<double>")
    one, many = ({r.curve_id: (r.cluster, r.persistence) for r in cluster_curves(df, hierarchy_limit=n).collect()} for n in (100_000, 150))
    assert len({c for c, _ in one.values()} - {None}) >= least and many == one


def test_condense_carries_stability():
    """Two kinds of 100 split at 0.25, their curves leave at 0.18: the parent is the more stable, however many calls it takes."""
    a = np.concatenate([np.arange(99), 100 + np.arange(99), [0]])
    b = np.concatenate([np.arange(1, 100), 100 + np.arange(1, 100), [100]])
    w = np.concatenate([np.full(198, 0.18), [0.25]])
    label, fall = condense(200, a, b, w, np.ones(200), 3, 0.2)
    assert len(set(label.tolist())) == 1 and label[0] >= 0 and np.allclose(fall, 0.18)


def test_clusters_of_few(spark):
    for rows in ([], [(1, [1.0] * 24)]):
        got = cluster_curves(spark.createDataFrame(rows, "curve_id bigint, qe array<double>")).collect()
        assert [(r.curve_id, r.cluster) for r in got] == [(i, None) for i, _ in rows]


def test_condense_against_cut():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.02, 40) for c in (0, 1, 3)])
    d = np.abs(x[:, None] - x[None])
    i, j = np.triu_indices(len(x), 1)
    order = np.argsort(d[i, j], kind="stable")
    keep = order[kruskal(len(x), i[order], j[order])]
    label, _ = condense(len(x), i[keep], j[keep], d[i, j][keep], np.ones(len(x)), 5, 0.3)
    assert len(set(label.tolist())) == 3 and all(len(set(label[a : a + 40].tolist())) == 1 for a in (0, 40, 80))


def test_shapes():
    s = shapes([[1.0] * 23, list(range(24)), [2.0] * 25, [None, *([4.0] * 23)], None])
    assert np.allclose(s[[0, 2, 3]], 1) and np.isnan(s[4]).all() and abs(s[1].mean() - 1) < 1e-12
