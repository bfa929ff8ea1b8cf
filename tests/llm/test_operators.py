"""Small cases of every operator against plain Python: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import gru, ngram_join, pii, quality, secrets
from lectern.llm import lm_score as lm
from lectern.llm import wordvec as wv
from lectern.llm.common import passes, token_filter
from lectern.llm.components import components
from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import exact_dedup, one_of_each_text
from lectern.llm.license_scan import SENTENCES, license_scan
from lectern.llm.line_dedup import line_dedup
from lectern.llm.lm_score import lm_score
from lectern.llm.mixing import mix_sources, running, shard_rows, split_quotas, targets
from lectern.llm.ngram_join import linked, ngram_classes, one_of_each_class
from lectern.llm.pii import pii_pseudonyms
from lectern.llm.quality import quality_classifier
from lectern.llm.queries import oracle_sql
from lectern.llm.secrets import secret_scan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "One two", "a\n\nB \n a", "é É\x0bx", "x\x00y z", "long " * 3000 + "end", "\n".join(f"line {i}" for i in range(500))]


def frame(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, words=40, vocabulary=60):
    r = np.random.RandomState(seed)
    v = ["".join(chr(97 + c) for c in r.randint(0, 26, 2 + k % 6)) for k in range(vocabulary)]
    return [" ".join(v[i] for i in r.randint(0, vocabulary, words)) for _ in range(n)]


def words(t):
    return WORD.findall((t or "").translate(LOW))


# Word vectors.


def test_words_are_those_of_the_pattern():
    texts = [t for t in ODD] + prose(20, 1)
    seen = {}
    for lo, hi, data, off in wv.slices(pa.array(texts), 50):
        w = wv.words(data, off, wv.SPACED)
        for r in range(hi - lo):
            own = [w.text(i).replace(b"\xff", b"\0").decode() for i in range(w.first[r], w.first[r + 1])]
            assert own == words(texts[lo + r])
            for i, x in zip(range(w.first[r], w.first[r + 1]), own):
                assert seen.setdefault(x, w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_rows():
    h, at = wv.windows(wv.words(*wv.buffers(pa.array(["a b c", "", "d e", "a b c d"])), wv.SPACED), 3)
    assert len(h) == 3 and h[0] == h[1] and h[1] != h[2]
    assert wv.run_hash(wv.words(*wv.buffers(pa.array(["a b c"])), wv.SPACED).hash) == h[0]


# 1.


def lines_of(texts, least, chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for ls in split for k in {key(x) for x in ls} if len(k) >= chars)
    kept = [[x for x in ls if count[key(x)] < least] for ls in split]
    return [("\n".join(k), len(ls), len(ls) - len(k)) for ls, k in zip(split, kept)]


def test_line_dedup(spark):
    texts = ODD + ["A\nshared Line\nz", "shared line \nq", "SHARED LINE\nshared line", None, "É\nshared line"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(frame(spark, texts), min_docs=3).collect()}
    assert [got[i] for i in range(len(texts))] == lines_of(texts, 3, 1)


def test_line_dedup_repeats_clashes_and_nothing(spark):
    docs = frame(spark, ["x\ny", "x\ny", "x"], ids=[1, 1, None]).withColumns({"n_lines": F.lit("mine"), "d": F.lit(1), "gone": F.lit(2), "key": F.lit(3)})
    got = line_dedup(docs, min_docs=3).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped, r.d, r.gone, r.key) for r in got) == [("", 1, 1, 1, 2, 3), ("y", 2, 1, 1, 2, 3), ("y", 2, 1, 1, 2, 3)]
    assert line_dedup(frame(spark, [])).count() == 0


# 6.


def weak(c):
    return [F.length(c) % 2, F.lit(0)]


@pytest.mark.parametrize("hashes", [None, weak])
def test_exact_dedup(spark, hashes):
    texts = ODD + ["one", "One", "one ", "b" * 9000, "b" * 9000, None, "a. b. c", "a. c. b"]
    args = {"low": 1, "high": 50} | ({"hashes": hashes} if hashes else {})
    got = {r.doc_id: r for r in exact_dedup(frame(spark, texts), **args).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same)), (i, got[i])
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_repeats_and_nulls(spark):
    docs = frame(spark, ["x", "x", "x", "y", "y", "z"], ids=[5, 5, 1, None, None, None]).withColumn("kept", F.lit("mine"))
    got = sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_dedup(docs).collect())
    assert got == sorted([("5", 3, True), ("5", 3, False), ("1", 3, False), ("None", 2, True), ("None", 2, False), ("None", 1, True)])
    stay = one_of_each_text(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.kept) for r in stay) == [("5", "x", "mine"), ("None", "y", "mine"), ("None", "z", "mine")]
    assert exact_dedup(frame(spark, [])).count() == 0 and one_of_each_text(frame(spark, [])).count() == 0


# 8.


def classes_of(texts, k=5, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(texts, share, seed, copies):
    r = np.random.RandomState(seed)
    out = []
    for t in texts:
        w = t.split()
        for _ in range(copies):
            v = list(w)
            for i in np.flatnonzero(r.rand(len(v)) < share * r.rand()):
                v[i] = f"new{r.randint(10**6)}"
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("crowd,block,near", [(48, 256, 50), (2, 7, 50), (3, 16, 101)])
def test_ngram_classes(spark, crowd, block, near):
    """With near above 100 there are no families: pairs of the prefix join alone give the same components."""
    options = {"crowd": crowd, "block": block, "near": near, "sketch_bits": 12}
    base = prose(6, 3, words=120, vocabulary=4000)
    passage = " ".join(prose(1, 9, words=40, vocabulary=900))
    texts = ODD + base + edited(base, 0.06, 4, 14) + ["One  two", "ONE", None] + [f"{p} {passage}" for p in prose(12, 5, words=14, vocabulary=5000)]
    want = classes_of(texts)
    docs = frame(spark, texts).withColumns({"n": F.lit(1), "sig": F.lit("mine"), "k1": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_classes(docs, **options).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 20
    if near > 100:
        return
    stay = one_of_each_class(docs, **options).collect()
    assert sorted(r.doc_id for r in stay) == [i for i, (n, c) in enumerate(want) if c == i]
    assert all(r.sig == "mine" and r.k1 == 2 for r in stay)


def test_crowd_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Each of 300 near copies has so many postings that only some of its tokens count for its family; it still joins it."""
    made, shared_tokens = [], ngram_join._shared_tokens
    monkeypatch.setattr(ngram_join, "_shared_tokens", lambda *a: made.append(ngram_join.materialize(shared_tokens(*a), "made")) or made[-1])
    r = np.random.RandomState(5)
    texts = []
    for i in range(300):
        w = [f"w{j}" for j in range(150)]
        w[r.randint(150)] = f"own{i}"
        texts.append(" ".join(w))
    got = ngram_classes(frame(spark, texts)).collect()
    assert {x.component_id for x in got} == {0}
    assert made[0].agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0] <= 10 * len(texts)


def test_ngram_classes_repeats_nulls_and_nothing(spark):
    docs = frame(spark, ["a b", "a b", "A  b", "", None, "c"], ids=[4, 4, None, 7, 8, 9])
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_classes(docs, sketch_bits=8).collect())
    assert got == sorted([("4", 1, 4), ("4", 1, 4), ("None", 1, 4), ("7", 0, 7), ("8", 0, 8), ("9", 1, 9)])
    assert sorted(r.doc_id for r in one_of_each_class(docs, sketch_bits=8).collect()) == [4, 7, 8, 9]
    assert ngram_classes(frame(spark, []), sketch_bits=8).count() == 0


def test_token_filter_holds_its_tokens(spark):
    t = np.random.RandomState(6).randint(-(2**63), 2**63 - 1, 3000)
    bits = token_filter(spark.createDataFrame([(int(x),) for x in t[:1000]], "token long"))
    there = passes(t.view(np.uint64), bits)
    assert there[:1000].all() and there[1000:].mean() < 0.1


def test_linked_is_exact():
    r = np.random.RandomState(2)
    sets = [np.unique(r.randint(0, 60, n).astype(np.uint64)) for n in r.randint(1, 60, 40)] + [np.zeros(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) > 0 and 100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert (linked(sets, sets, 50) == np.asarray(want)).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (95, 100), (200, 200), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4.


def hits_of(texts, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    out = []
    for t in texts:
        w, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for item, u in items:
            v = word.findall((u or "").translate(LOW))
            m = min(window, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == v[i : i + m]:
                        hit |= set(range(j, j + m))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_decontaminate(spark, block_chars):
    bench = prose(6, 11, words=25)
    items = [*enumerate(bench), (7, "Short item"), (8, None), (9, ""), (0, bench[0]), (10, "same same same same same same same same same same same same")]
    w = [b.split() for b in bench]
    texts = ODD + prose(10, 12, words=60) + [
        "intro " + " ".join(w[0][3:13]).upper() + ", out", " ".join(w[1][2:11]), " ".join(w[2][:15] + w[3][5:16]), "a SHORT-item b short item",
        "x " + ", ".join(w[4]) + " y " + " ".join(w[4][:12]), "same " * 25, " ".join(w[5][:10]) + "é",
    ]
    docs = frame(spark, texts).withColumns({"items": F.lit("mine"), "f": F.lit(1), "d": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(docs, b, block_chars=block_chars).collect()}
    want = hits_of(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x[3] for x in want) == 5


def test_decontaminate_nothing(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[-4:] for r in decontaminate(frame(spark, ["a b"]), b).collect()] == [(2, 0, [], False)]
    assert decontaminate(frame(spark, []), b).count() == 0


# 7.


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 200 * 5 / 6, 100 * 5 / 6])
    assert targets([], [], 1.5, 2) == [] and targets([0, 0], [5, 2], 1.5, 2) == [0, 0]
    t = targets([10, 1000, 10, 10], [5, 2, 1, 5], 1.5, 2.0)
    assert sum(t) == pytest.approx(1545) and all(x <= 2 * s for x, s in zip(t, [10, 1000, 10, 10]))


def test_targets_against_a_water_level():
    """The same by bisection: one level times the weights, cut off at each source's bound."""
    r = np.random.RandomState(7)
    for _ in range(50):
        n = r.randint(1, 9)
        sizes, weights = r.randint(0, 1000, n).astype(float), [(5, 2, 1)[i % 3] for i in range(n)]
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < 1.5 * sizes.sum():
                lo = mid
            else:
                hi = mid
        assert targets(list(sizes), weights, 1.5, 2.0) == pytest.approx([min(2 * s, hi * w) for s, w in zip(sizes, weights)], rel=1e-6, abs=1e-6)


def test_running_sums(spark):
    r = np.random.RandomState(9)
    rows = [(int(k), int(p), int(o), i, int(v)) for i, (k, p, o, v) in enumerate(zip(r.randint(0, 3, 400), r.randint(0, 2, 400), r.choice(r.randint(-(2**63), 2**63 - 1, 150), 400), r.randint(0, 9, 400)))]
    df = spark.createDataFrame(rows, "k long, pass long, o long, i long, v long")
    got = {x.i: x.before for x in running(df, "k", "o", "i", F.col("v"), "pass").collect()}
    for k in range(3):
        total = 0
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:4]):
            assert got[x[3]] == total
            total += x[4]


def test_split_quotas():
    q = np.asarray([100, 7, 0, 45])
    out = split_quotas(q, 16, 3)
    assert (out.sum(0) == q).all() and np.ptp(out.sum(1)) <= 4 and (out >= 0).all()
    assert (out == split_quotas(q, 16, 3)).all()


def test_mix_sources(spark):
    texts = ODD + prose(60, 21, words=30) + prose(5, 22, words=300)
    sources = [["b", "a", None, "c"][i % 4] if i % 3 else "b" for i in range(len(texts))]
    docs = frame(spark, texts, sources).withColumns({"size": F.lit("mine"), "src": F.lit(1)})
    rows = mix_sources(docs, shards=4, block_docs=3).collect()
    sizes = {i: len(words(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == sizes
    order = ["a", "b", "c", None]
    per = [sum(sizes[i] for i in sizes if sources[i] == s) for s in order]
    want = dict(zip(order, targets(per, [5, 2, 1, 5], 1.5, 2.0)))
    for s in order:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == per[order.index(s)]
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(len(r.shards) == r.passes + (r.part > 0) for r in rows)
    again = mix_sources(docs.repartition(7), shards=4, block_docs=3).collect()
    pick = lambda rs: sorted((r.doc_id, r.taken, tuple(r.shards)) for r in rs)
    assert pick(rows) == pick(again)
    copies = shard_rows(mix_sources(docs, shards=4, block_docs=3)).withColumn("p", F.spark_partition_id()).collect()
    held = Counter()
    for r in copies:
        held[r.doc_id] += r.words
    assert held == {r.doc_id: r.taken for r in rows if r.taken}
    home = {(r.doc_id, c): (s, o) for r in rows for c, (s, o) in enumerate(zip(r.shards, r.orders))}
    assert all(home[r.doc_id, r.copy] == (r.shard, r.order) for r in copies) and len({o for _, o in home.values()}) == len(home)
    for a, b in zip(copies, copies[1:]):
        assert a.p != b.p or (a.shard, a.order) <= (b.shard, b.order)


def test_mix_sources_repeats_and_nothing(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    assert [(r.size, r.taken) for r in mix_sources(frame(spark, ["", None])).collect()] == [(0, 0), (0, 0)]
    rows = mix_sources(frame(spark, ["a b", "a b", "c"], ids=[1, 1, None])).collect()
    assert len(rows) == 3 and sum(r.taken for r in rows) == 8 and all(r.taken <= 2 * r.size for r in rows)


# 2.


def test_quality(spark):
    good, bad = prose(120, 31), [" ".join(x + "###" for x in t.split()) for t in prose(60, 32)] + [" ".join([x] * 30) for x in prose(60, 33, words=1)]
    texts = good + bad + ODD
    docs = frame(spark, texts).withColumns({"y": F.lit("mine"), "k": F.lit(1), "t": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 240)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_classifier(docs, labels).collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.y == "mine"
    held = [i for i in range(240) if rows[i].held_out]
    assert sum(rows[i].predicted == (i < 120) for i in held) >= 0.95 * len(held)
    assert quality_classifier(frame(spark, []), labels).count() == 0
    none = quality_classifier(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert [r.held_out for r in quality_classifier(frame(spark, ["x"], ids=[None]), labels).collect()] == [False]


def test_ftrl_against_plain_python():
    """Weights coordinate by coordinate, scores by the sum over a text's n-grams."""
    texts = prose(12, 34, words=9, vocabulary=12) + ["", "a a a", "x, y!"]
    labels = np.asarray([i % 2 for i in range(len(texts))], float)
    data = [dict(zip(at.tolist(), x.tolist())) for at, x in quality.examples(pa.array(texts))]
    for t, x in zip(texts, data):
        toks = re.findall(r"[^\W_]+|[^\w\s]+", t)
        pairs = len(toks) + max(0, len(toks) - 1) + sum(a == b for a, b in zip(toks, toks[1:]))
        assert sum(v for k, v in x.items() if k != 1 << quality.BITS) == pytest.approx(quality.GAIN if pairs else 0)
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for e in range(2):
        for i in np.random.RandomState(e).permutation(len(data)):
            w = {k: weight(k) for k in data[i]}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in data[i].items())))
            for k, v in data[i].items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    got = quality.train(pa.array(texts), labels, epochs=2)
    assert {int(k): float(got[k]) for k in np.flatnonzero(got)} == pytest.approx({k: weight(k) for k in z if weight(k)}, rel=1e-4, abs=1e-6)
    want = [1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()))) for x in data]
    assert quality.score(pa.array([*texts, None]), got) == pytest.approx([*want, want[12]], rel=1e-4)


# 3.


def test_secrets(spark):
    made = ['password = "hunter22"', "Secret: abc", "API_KEY='Zz9+/_.=-x'", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "deadbeef" * 3, "é" * 5 + ' token="' + "0123456789abcdef" * 2 + '" x', "token:token:abcdefg", "ſecret = abcdefgh", "secret secret=toolong1"]
    texts = ODD + made + ["deadbeefdeadbeef", "cafecafecafe"] + prose(30, 41)
    docs = frame(spark, texts).withColumns({"base": F.lit("mine"), "spans0": F.lit(1)})
    rows = {r.doc_id: r for r in secret_scan(docs).collect()}
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in rule.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        got = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in rows[i]["base"]]
        assert got == sorted(want), (t, got)
        assert set(got) <= {(s.start, secrets.KINDS.index(s.kind), s.end) for s in rows[i].spans}
    assert all(len(rows[i].spans) == len(rows[i]["base"]) for i in range(len(ODD) + len(made), len(texts)))
    assert secret_scan(frame(spark, [])).count() == 0


def _finds(net, scale, threshold, made):
    p = 1 / (1 + np.exp(-scale * net.logits(np.asarray([secrets.encode(t, a, b) for t, a, b, _ in made]))))
    return {k: float(np.mean([x >= threshold for x, m in zip(p, made) if m[3] == k])) for k in {m[3] for m in made}}


def test_network_finds_kinds_that_it_has_not_learnt(monkeypatch):
    """Networks that never saw the kinds of a fold, on new secrets of these kinds, at the threshold of fit."""
    _, scale, threshold = secrets.fit([], [])
    learnt, fresh = secrets.made_findings(3600), secrets.made_findings(2000, seed=78)
    kinds = secrets.SECRETS + secrets.OTHERS
    for f in range(3):
        rest = [m for m in learnt if kinds.index(m[3]) % 3 != f]
        net = secrets.Network()
        net.fit(np.asarray([secrets.encode(t, a, b) for t, a, b, _ in rest]), np.asarray([m[3] in secrets.SECRETS for m in rest], np.float32), epochs=4)
        found = _finds(net, scale, threshold, [m for m in fresh if kinds.index(m[3]) % 3 == f])
        assert all(found[k] >= 0.9 for k in found if k in secrets.SECRETS), found


def test_secrets_of_no_rule_are_found(spark):
    """End to end: secrets that no base rule defines, many of them in the corpus, and look-alikes."""
    made = [m for m in secrets.made_findings(900, seed=79) if not secrets.base_spans(m[0])]
    rows = {r.doc_id: r for r in secret_scan(frame(spark, [t for t, *_ in made] + prose(60, 42))).collect()}
    hit = [any(s.kind == "net" and s.start < hi and lo < s.end for s in rows[i].spans) for i, (_, lo, hi, _) in enumerate(made)]
    for kind in secrets.SECRETS:
        own = [h for h, m in zip(hit, made) if m[3] == kind]
        assert not own or np.mean(own) >= 0.9, (kind, np.mean(own))
    assert np.mean([h for h, m in zip(hit, made) if m[3] in secrets.OTHERS]) <= 0.05
    assert all(not rows[i].spans for i in range(len(made), len(made) + 60))


def test_secrets_apply_the_threshold_of_fit(spark, monkeypatch):
    net, scale, _ = secrets.fit([], [], made=600, folds=2)
    made = secrets.made_findings(300, seed=78)
    monkeypatch.setattr(secrets, "fit", lambda *a, **k: (net, scale, 0.0))
    texts = [t for t, *_ in made]
    rows = {r.doc_id: r for r in secret_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        free = [c for c in secrets.candidates(t) if not any(a < c[1] and c[0] < e for a, _, e in secrets.base_spans(t))]
        assert [(x.start, x.end) for x in rows[i].spans if x.kind == "net"] == free


def test_secrets_keep_columns_of_odd_names(spark):
    docs = frame(spark, ["token=abcdefgh", None]).withColumns({"a.b": F.lit(1), "__scan": F.lit(2), "d": F.lit(3), "s": F.lit(4), "base": F.lit("mine")})
    rows = secret_scan(docs).orderBy("doc_id").collect()
    assert [(r["a.b"], r["__scan"], r.d, r.s, len(r["base"])) for r in rows] == [(1, 2, 3, 4, 1), (1, 2, 3, 4, 0)]


def test_secrets_see_whole_candidates(spark, monkeypatch):
    net = secrets.Network()
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}  # finds a 9 within a candidate
    net.p["e"][ord("9") + 1, 0] = net.p["k"][0, 0] = net.p["w"][secrets.FILTERS] = 1
    net.p["o"][0] = -0.5
    monkeypatch.setattr(secrets, "fit", lambda *a, **k: (net, 10.0, 0.5))
    texts = ["set_" + "name_" * 10 + "1=" + key for key in ("kkkkk9kkkkkkkkkkkk", "kkkkk8kkkkkkkkkkkk", "k" * 3000 + "9kkkkkkk")] + ["name_name_name_9_name"]
    rows = {r.doc_id: r for r in secret_scan(frame(spark, texts)).collect()}
    assert [[(x.start, x.end) for x in rows[i].spans] for i in range(4)] == [[(0, len(texts[0]))], [], [(0, len(texts[2]))], [(0, 21)]]


def test_network_gradients():
    net = secrets.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.RandomState(0).randint(1, 100, (4, secrets.LENGTH))
    y = np.asarray([1, 0, 1, 0.0])
    loss = lambda: np.mean(np.logaddexp(0, -(2 * y - 1) * net.forward(x)[0]))
    g = net.gradients(x, y)
    for k in net.p:
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old, eps = net.p[k][at], 1e-5
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[k][at], rel=1e-2, abs=1e-6), k


# 10.


def test_gru_gradients():
    p = {k: v.astype(np.float64) for k, v in gru.start(np.arange(1, 8.0), 3, 3).items()}
    r = np.random.RandomState(1)
    x, y = r.randint(0, 8, (5, 4)), r.randint(0, 7, (5, 4))
    fresh = x == 7
    h = r.standard_normal((4, 3))
    g, _, _ = gru.gradients(p, x, y, fresh, h)
    for k in p:
        for at in [tuple(i) for i in np.argwhere(np.abs(g[k]) > 1e-9)[::5]]:
            old, eps = p[k][at], 1e-5
            p[k][at] = old + eps
            up = gru.gradients(p, x, y, fresh, h)[2]
            p[k][at] = old - eps
            down = gru.gradients(p, x, y, fresh, h)[2]
            p[k][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[k][at], rel=2e-2, abs=1e-6), (k, at)


def test_gru_scores_are_probabilities_of_whole_texts():
    p = gru.start(np.arange(1, 6.0), 4, 2)
    texts = [np.asarray(t) for t in ([0, 1, 4], [2] * 200, [4], [1, 4])]
    one = [gru.score(p, [t])[0] for t in texts]
    assert gru.score(p, texts, block=7) == pytest.approx(one, rel=1e-5)
    two = [gru.score(p, [np.asarray([a, b])])[0] for a in range(5) for b in range(5)]
    assert np.exp(two).sum() == pytest.approx(1, abs=1e-4)
    assert gru.score(p, []).shape == (0,)
    back = gru.unpack(gru.pack(p), 5, 4, 2)
    assert all((back[k] == p[k]).all() for k in p)


def test_lm_score(spark):
    a, b = prose(60, 51, vocabulary=20), prose(60, 52, vocabulary=20)
    texts = a + b + ODD + prose(5, 53, vocabulary=500)
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, texts, ids=ids).withColumns({"held_out": F.lit("mine"), "s": F.lit(1), "h": F.lit(2)})
    rows = {r.doc_id: r for r in lm_score(docs, vocabulary=63, common=200, hidden=8, classes=8, updates=150).collect()}
    toks = {i: [*words(t), None] for i, t in zip(ids, texts)}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids}
    c = Counter(w for i in ids if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i in ids:
        r = rows[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    own = [i for i in range(120) if held[i]]
    assert sum(rows[i].score for i in own) > sum(rows[i].base_score for i in own)
    assert lm_score(frame(spark, [])).count() == 0
    twice = lm_score(frame(spark, ["q w e", "q w e"], ids=[3, 3]), vocabulary=3, common=2, hidden=2, classes=2, updates=1).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_known == 4 and twice[0].train_tokens == 8


def test_gru_trains_on_every_token(monkeypatch):
    """The windows of one pass hold every token of every text, the tail of the last lane too."""
    seen = Counter()
    plain = gru.gradients
    monkeypatch.setattr(gru, "gradients", lambda p, x, y, f, h: (seen.update(map(tuple, np.stack([x.ravel(), y.ravel()], 1))), plain(p, x, y, f, h))[1])
    r = np.random.RandomState(4)
    texts = [r.randint(0, 50, n) for n in (1, 7, 200, 33, 64, 5)]
    gru.train(gru.start(np.ones(50), 2, 5), texts, 1, 0.01, lanes=8)
    want = Counter((int(a), int(b)) for t in texts for a, b in zip([50, *t[:-1]], t))
    assert all(seen[k] >= n for k, n in want.items())


def test_gru_works_in_a_small_space():
    """Predictions of many tokens and the gradients of a wide window never lie in memory as a whole; they are the same as token by token."""
    r = np.random.RandomState(6)
    p = gru.start(np.arange(4096, 0, -1.0), 20, 64)
    h, y = np.tanh(r.standard_normal((1 << 15, 20))).astype(np.float32), r.randint(0, 4096, 1 << 15)
    inputs, fresh = r.randint(0, 4097, (16, 1024)), r.rand(16, 1024) < 0.01
    peaks = []
    for run in (lambda: gru._log_p(p, h, y, True), lambda: gru.gradients(p, inputs, y[: 1 << 14].reshape(16, 1024), fresh, h[:1024])):
        tracemalloc.start()
        got = run()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if len(peaks) == 1:
            one = np.concatenate([gru._log_p(p, h[i : i + 1], y[i : i + 1], True) for i in range(0, 1 << 15, 97)])
            assert got[::97] == pytest.approx(one, rel=1e-4)
    # All outputs at once would be 8 MB for the predictions, 4 MB each for class and word in the window.
    assert peaks[0] < 4 << 20 and peaks[1] < 24 << 20, peaks


def test_token_lookup(monkeypatch):
    """Lookup by leading bits finds what a plain search finds; cutting texts for it changes no token."""
    r = np.random.RandomState(7)
    near = (np.uint64(5) << np.uint64(60)) + np.arange(0, 40, 2, dtype=np.uint64)
    for some in (r.randint(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), near, near[:1], near[:0]):
        table = lm.table_of(np.unique(some))
        h = np.concatenate([some, some + np.uint64(1), r.randint(0, 1 << 63, 500).astype(np.uint64), np.asarray([0, 0x0E0D, 2**64 - 1], np.uint64)])
        at, there = lm._find(h, table)
        assert (there == np.isin(h, some)).all() and (table.hashes[at[there]] == h[there]).all()
    texts = pa.array(prose(30, 56) + ODD + ["", "last"])
    whole = lm.tokens(*wv.buffers(texts))
    monkeypatch.setattr(lm, "NEAR_BYTES", 50)
    cut = lm.tokens(*wv.buffers(texts))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def _net_log10(p, ids):
    """log10 of a text's probability, one token after another in plain numpy."""
    n, per = p["u"].shape[0], p["bo"].shape[1]
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, prev, total = np.zeros(n), p["x"].shape[0] - 1, 0.0
    for y in ids:
        x, g = p["x"][prev].astype(float), h @ p["u"]
        z, r = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
        c = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * c + z * h
        for a, at in ((h @ p["wc"] + p["bc"], y // per), (h @ p["wo"][y // per] + p["bo"][y // per], y % per)):
            total += a[at] - np.log(np.exp(a - a.max()).sum()) - a.max()
        prev = y
    return total / np.log(10)


def test_lm_score_is_that_of_the_network(spark, monkeypatch):
    """score by hand from the trained weights: the network's part, times the share of each word it does not know."""
    texts = prose(60, 55, vocabulary=40) + ODD + ["only rare words here"]
    kept = {}
    plain = lm.fit
    monkeypatch.setattr(lm, "fit", lambda train, words, counts, *a: kept.update(words=words, counts=counts, p=plain(train, words, counts, *a)) or kept["p"])
    rows = {r.doc_id: r for r in lm_score(frame(spark, texts), vocabulary=15, common=30, hidden=4, classes=4, group_docs=16, updates=20).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    toks = [[*words(t), None] for t in texts]
    c = Counter(w for i, ws in enumerate(toks) if not held[i] for w in ws)
    hashes = {}
    for w in {w for ws in toks for w in ws}:
        h = lm.tokens(*wv.buffers(pa.array([w or ""])))[0]
        hashes[w] = h[0]
    known = {int(h): i for i, h in enumerate(kept["words"])}
    other = [w for w in c if int(hashes[w]) not in known]
    norm = math.log10(sum(c[w] for w in other) + 0.1 * (len(other) + 1))
    assert list(kept["counts"][:-1]) == sorted(c.values(), reverse=True)[:15] and kept["counts"][-1] == sum(c[w] for w in other)
    for i, ws in enumerate(toks):
        ids = [known.get(int(hashes[w]), len(known)) for w in ws]
        want = _net_log10(kept["p"], ids) + sum(math.log10(c[w] + 0.1) - norm for w, k in zip(ws, ids) if k == len(known))
        assert rows[i].score == pytest.approx(want, rel=1e-4, abs=1e-3), i


# 9.


def test_pii(spark):
    texts = ["card 4111 1111 1111 1111, bad 4111 1111 1111 1112; +1 (743) 555-3824 or 212-555-0123.", "1987-02-28, 28.02.1987, 2023-02-30; 10.0.0.1 v1.2.3.4 300.1.1.1 1.2.3.4.5; 123-45-6789 000-45-6789; a.b@c.de; 4111111111111111"]
    docs = frame(spark, ODD + texts).withColumns({"kinds": F.lit("mine"), "m": F.lit(1), "new": F.lit(2)})
    rows = {r.doc_id: r for r in pii_pseudonyms(docs, "k").collect()}
    for i, t in enumerate(ODD):
        assert rows[i].text == t and rows[i].n_found == 0 and rows[i].m == 1
    a, b = rows[len(ODD)], rows[len(ODD) + 1]
    assert a.kinds == ["card", "phone", "phone"] and b.kinds == ["date_iso", "date_day", "ip", "ssn", "email", "card"]
    assert "4111 1111 1111 1112" in a.text and "v1.2.3.4 300.1.1.1 1.2.3.4.5" in b.text and "000-45-6789" in b.text
    card = re.search(r"card ((\d{4} ){3}\d{4}),", a.text)[1].replace(" ", "")
    assert card != "4111111111111111" and b.text.endswith(card)
    assert pii_pseudonyms(frame(spark, []), "k").count() == 0
    other = pii_pseudonyms(docs, "other").where(F.col("doc_id") == len(ODD)).collect()[0]
    assert other.text != a.text


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(7 * 11).select((F.col("id") % 7).alias("a"), F.floor(F.col("id") / 7).alias("b"))
    p = pairs.select(pii.feistel(F.col("a"), F.col("b"), F.lit(7), F.lit(11), F.lit("key"), F.lit("t")).alias("p"))
    got = {(r.p.a, r.p.b) for r in p.collect()}
    assert len(got) == 77 and all(0 <= x < 7 and 0 <= y < 11 for x, y in got)


def test_pseudonyms_keep_validity(spark):
    days = spark.range(0, 73049, 365).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("m"))
    got = days.select(pii.pseudonym(F.col("m"), F.lit("k")).alias("p")).select("p", pii.kind_of(F.col("p")).alias("k")).collect()
    assert {r.k for r in got} == {"date_iso"} and len({r.p for r in got}) == days.count()
    cards = spark.range(200).select(F.concat(F.lpad((F.col("id") * 7919).cast("string"), 15, "4"), pii.luhn_digit(F.lpad((F.col("id") * 7919).cast("string"), 15, "4")).cast("string")).alias("m"))
    got = cards.select(pii.pseudonym(F.col("m"), F.lit("k")).alias("p")).select("p", pii.kind_of(F.col("p")).alias("k")).collect()
    assert {r.k for r in got} == {"card"} and len({r.p for r in got}) == 200


# 5.


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    texts = ODD + ["x\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", mit, "Licensed under CC BY-NC 4.0. And all rights reserved.", "a licence to drive", "Released under the MIT License.\n" * 3]
    docs = frame(spark, texts).withColumns({"rules": F.lit("mine"), "ids": F.lit(1), "left": F.lit(2)})
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    n = len(ODD)
    assert all(rows[i].licenses == [] and rows[i].rules == [] and rows[i].ids == 1 for i in [*range(n), n + 3])
    assert rows[n].licenses == ["Apache-2.0", "MIT"] and rows[n].rules == ["MIT:notice", "Apache-2.0:notice"]
    assert rows[n + 1].rules == ["MIT:text"]
    assert rows[n + 2].licenses == ["CC-BY-NC-4.0"]
    assert rows[n + 4].rules == ["MIT:notice"] * 3
    assert license_scan(frame(spark, [])).count() == 0


def test_license_scan_reads_wrapped_texts(spark):
    mit = """MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n"""
    apache = """Copyright 2020 Some One\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n"""
    gpl = """This program is free software%s\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation%s of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"""
    texts = [mit, apache, gpl % ("; you can redistribute it and/or modify", "; either version 2"), gpl % (": you can redistribute it and/or modify", ", either version 3"), mpl]
    rows = {r.doc_id: r.rules for r in license_scan(frame(spark, texts)).collect()}
    assert [rows[i] for i in range(5)] == [["MIT:text"], ["Apache-2.0:header"], ["GPL-2.0-or-later:header"], ["GPL-3.0-or-later:header"], ["MPL-2.0:header"]]


WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
BSD = [
    "Copyright (c) 2020, Some One",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
CANONICAL = {
    "MIT:text": [
        "MIT License", "Copyright (c) 2020 Some One",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0:header": [
        "Copyright 2020 Some One",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0-or-later:header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0-or-later:header": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "MPL-2.0:header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause:text": [*BSD, WARRANTY],
    "BSD-3-Clause:text": [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", WARRANTY],
    "ISC:text": ["Copyright (c) 2020, Some One", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."],
    "LGPL-2.1-or-later:header": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0-or-later:header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "Zlib:text": ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "GPL-3.0:title": ["GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "Copyright (C) 2007 Free Software Foundation, Inc."],
    "MIT:tag": ["SPDX-License-Identifier: MIT"],
    "Unlicense:notice": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def test_license_scan_reads_canonical_texts_at_any_width(spark):
    cases = [(name, "\n\n".join(lead + textwrap.fill(x, width).replace("\n", "\n" + lead) for x in parts)) for name, parts in CANONICAL.items() for width in (60, 72, 80, 10_000) for lead in ("", "# ", "    ", " * ")]
    rows = {r.doc_id: list(r.rules) for r in license_scan(frame(spark, [t for _, t in cases])).collect()}
    wrong = [(name, rows[i], t) for i, (name, t) in enumerate(cases) if rows[i] != [name]]
    assert not wrong, wrong[0]


def test_license_scan_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.RandomState(8)
    every = [x for parts in CANONICAL.values() for x in parts]
    texts = ODD + ["\n".join(textwrap.fill(every[i], int(r.randint(30, 90))) for i in r.randint(0, len(every), 6)) for _ in range(60)] + [". ".join(r.permutation(list(SENTENCES.values()))[:9]) for _ in range(40)]
    pdf = frame(spark, texts).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", pdf)
    want = {i: (n, lic, rules) for i, n, lic, rules in con.execute(f"SELECT doc_id, n_sentences, licenses, rules FROM ({oracle_sql()['op5_license_scan']})").fetchall()}
    out = license_scan(frame(spark, texts)).select("doc_id", F.size("sentence_ids"), F.array_join("licenses", ","), F.array_join("rules", ",")).collect()
    assert {x[0]: tuple(x[1:]) for x in out} == want
    assert sum(bool(v[2]) for v in want.values()) > 40


def test_license_scan_cues_may_wrap(spark):
    texts = ["All rights\nreserved.", "All rights  reserved.", "This is free and unencumbered software released into the public\ndomain."]
    assert [r.licenses for r in license_scan(frame(spark, texts)).orderBy("doc_id").collect()] == [["all-rights-reserved"]] * 2 + [["Unlicense"]]


def test_pii_numbers_before_a_form(spark):
    forms = ["2024-01-15", "415-555-2671", "(415) 555-2671", "123-45-6789", "28.02.1987", "10.0.0.1", "4111 1111 1111 1111", "a.b@c.de"]
    want = ["date_iso", "phone", "phone", "ssn", "date_day", "ip", "card", "email"]
    texts = [f"{n} {x}, end" for x in forms for n in ("12345", "id 1003", "5001", "12345678 1235")]
    alone = {x: r.text for x, r in zip(forms, pii_pseudonyms(frame(spark, forms), "k").orderBy("doc_id").collect())}
    rows = pii_pseudonyms(frame(spark, texts), "k").orderBy("doc_id").collect()
    odd = ("5001 4111", "id 1003 4111", "1235 4111")  # four digits before a card's groups make one more group
    for i, r in enumerate(rows):
        if not any(o in texts[i] for o in odd):
            assert r.kinds == [want[i // 4]] and r.text == texts[i].replace(forms[i // 4], alone[forms[i // 4]]), (texts[i], r)
    both = pii_pseudonyms(frame(spark, ["4111 1111 1111 1111, 1234567890 415 555 2671 or 12345 2024-01-15 at 10.0.0.1"]), "k").first()
    assert both.kinds == ["card", "phone", "date_iso", "ip"] and "1234567890 " in both.text


def test_bitmaps_of_several_lengths(spark):
    """Near copies on both sides of the sizes at which bitmaps get longer."""
    base = prose(3, 91, words=1040, vocabulary=50_000) + prose(2, 92, words=2060, vocabulary=50_000)
    texts = base + edited(base, 0.04, 93, 3) + [" ".join(t.split()[: int(len(t.split()) * 0.85)]) for t in base]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_classes(frame(spark, texts), crowd=2, near=101).collect()}
    want = classes_of(texts)
    assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) < len(texts) / 2
