"""Quotes meet a talk in blocks: the same answers as one by one, and no token is shuffled by itself."""

import difflib
import random

import pytest

from lectern.functions.text import exact_tokens, fast_tokens, token_line
from lectern.operators import anchor, brief
from lectern.operators.runs import Runs, numbers

from .test_bruteforce import Said, grounded, tokens

SEGMENTS, SLIDES = "talk_id long, seg_idx long, start_ms long, end_ms long, text string", "talk_id long, idx long, first_seen_ms long, ocr_text string"


def talk(r, n, words="ab abc bc 4 40 c cab a4 ca b"):
    words = words.split()
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(n)]


def frames_of(spark, said, shown):
    segs = [(k, i, 1000 * i, 1000 * i + 1000, x) for k, v in said.items() for i, x in enumerate(v)]
    deck = [(k, i, 7000 * i, x) for k, v in shown.items() for i, x in enumerate(v)]
    return spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(deck, SLIDES)


def changed(r, line):
    words = line.split()
    for _ in range(r.randint(0, 2)):
        words[r.randrange(len(words))] = r.choice(["ab", "40", "x", "…", "caba"])
    return " ".join(words)


def test_stamps_shuffle_no_tokens(spark):
    """q77_chapter_stamps: a plan of few exchanges, in which texts are not made into rows of tokens."""
    segs, deck = frames_of(spark, {1: ["so we say this here", "and that"]}, {1: ["on a slide we show that", None]})
    said = spark.createDataFrame([(1, "chapters", 0, "we say this here"), (1, "chapters", 1, "a slide we show"), (1, "slides", 3, None)], "talk_id long, path string, ord long, quote string")
    marked = brief.stamped(said, segs, deck)
    assert [tuple(x) for x in brief.chapter_starts(marked).orderBy("ord").collect()] == [(1, 0, "we say this here", 0), (1, 1, "a slide we show", 0)]
    plan = marked._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and marked._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 12


def test_quotes_beyond_a_block(spark):
    """q24_cascade: more quotes of a talk than go into a block, with quotes and rows that nothing can be said of."""
    r = random.Random(3)
    said = {1: talk(r, 60), 2: talk(r, 5), 3: [""]}
    shown = {1: [*talk(r, 3), None], 2: talk(r, 6), 4: talk(r, 2)}
    quotes = []
    for k in (1, 2, 3, 4):
        lines = [x for x in [*said.get(k, []), *shown.get(k, [])] if x]
        quotes += [(k, changed(r, r.choice(lines))) for _ in range(anchor.BLOCK + 50 if k == 1 else 40)] if lines else []
    quotes += [(1, None), (1, ""), (1, "…"), (1, "ab … … c"), (5, "ab abc"), (None, "ab abc bc c"), (3, "...")]
    rows = [(i, k, q) for i, (k, q) in enumerate(quotes)]
    segs, deck = frames_of(spark, said, shown)
    asked = spark.createDataFrame(rows, "quote_id long, talk_id long, quote string")
    spoken = {k: Said([(1000 * i, 0, x) for i, x in enumerate(said.get(k, []))]) for k in (1, 2, 3, 4, 5)}
    for toks in (fast_tokens, exact_tokens):
        got = {x.quote_id: (x.t, x.grounded, x.source) for x in anchor.anchor(asked, segs, deck, toks).collect()}
        assert len(got) == len(rows)
        for i, k, q in rows:
            want = grounded(q, spoken[k], [(0, 0, 7000 * j, [], x) for j, x in enumerate(shown.get(k, []))]) if k and q else (None, False, None)
            assert got[i] == want, (k, q)
    assert {x[2] for x in got.values()} == {"speech", "slide", None}


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = random.Random(seed)
    words = tokens(" ".join(talk(r, 70, "a4 b c" if seed % 2 else "the of and then 7 17 seven onethe oft")))
    quotes = []
    for m in (1, 2, 3, 4, 5, 8, 9, 31, 300):
        for _ in range(9):
            s = r.randrange(len(words))
            q = list(words[s : s + m])
            if r.random() < 0.7:
                q[r.randrange(len(q))] = r.choice([q[0], "onex", "7"])
            quotes.append(tuple(q))
    text, plain = Runs(words, quotes), Said([(0, 0, " ".join(words))])
    own = [numbers(" ".join(q)) for q in quotes]
    near, some = text.nearest(quotes, own, 0.85), text.nearest(quotes, own, 0.85, first=True)
    assert set(near) == set(some)
    for i, q in enumerate(quotes):
        assert list(text.places(q)) == plain.places(list(q))
        best = plain.nearest(list(q), 0.85)
        assert near.get(i) == best
        assert i not in near or difflib.SequenceMatcher(None, " ".join(words[near[i][1] : near[i][1] + len(q)]), " ".join(q)).ratio() == near[i][0]


def test_token_line(spark):
    texts = ["", " … ", "A_b  c4\n½ ﬁn", "Straße K2.6 -x-", None, "ΑΣ Ⅳ é"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    for toks in (fast_tokens, exact_tokens):
        for x in df.select(token_line(df.text, toks).alias("line"), toks(df.text).alias("toks")).collect():
            assert x.line == " ".join(x.toks or [])
