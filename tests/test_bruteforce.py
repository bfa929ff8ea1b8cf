"""Queries that SQL cannot say, held against plain Python on whole small tables."""

import difflib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.functions.text import normal
from lectern.operators import brief
from lectern.plans import catalog
from lectern.sources import adapters
from lectern.sources.tables import table

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\W_]+")


def rows_of(spark, name):
    return table(spark, SF, name).collect()


def tokens(text):
    return TOKEN.findall(text.lower())


@pytest.fixture(scope="module")
def talks(spark):
    """Segments (start, end, text) of each talk, in order."""
    out = defaultdict(list)
    clock = Counter()
    for r in sorted(rows_of(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        first = True
        for line in r.text.split("\n"):
            n = len(line.split())
            if n:
                clock[r.conv_id] += r.turn * 7 % 5 * 20_000 if first else 0
                out[r.conv_id].append((clock[r.conv_id], clock[r.conv_id] + 400 * n, line))
                clock[r.conv_id] += 400 * n
                first = False
    return out


@pytest.fixture(scope="module")
def decks(spark, talks):
    """Slides of each talk, in order: (id, idx, first seen, spans, text)."""
    out = defaultdict(list)
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id):
        deck = out[r.doc_id % len(talks)]
        at = len(deck) * 20_000
        spans = [(at, at + 20_000)] + ([(at + 200_000, at + 210_000)] if len(deck) % 3 == 2 else [])
        deck.append((r.doc_id, len(deck), at, spans, r.text))
    return out


def same_numbers(a, b):
    return sorted(re.findall(r"\d+", a)) == sorted(re.findall(r"\d+", b))


class Said:
    def __init__(self, segments, tok=tokens):
        self.toks, self.t, self.tok = [], [], tok
        for start, _, text in segments:
            for w in tok(text):
                self.toks.append(w)
                self.t.append(start)

    def places(self, q, start=0):
        return [i for i in range(start, len(self.toks) - len(q) + 1) if self.toks[i : i + len(q)] == q] if q else []

    def nearest(self, q, least):
        best, text, own = None, " ".join(q), set(q)
        for i in range(len(self.toks) - len(q) + 1):
            run = self.toks[i : i + len(q)]
            if len(own.intersection(run)) * 2 >= len(q):
                line = " ".join(run)
                r = difflib.SequenceMatcher(None, line, text).ratio()
                if r >= max(least, best[0] if best else 0) and same_numbers(line, text):
                    best = (r, i)
        return best


def on_slides(q, deck, tok=tokens):
    text = " ".join(q)
    for _, _, at, _, shown in deck:
        there = tok(shown or "")
        for i in range(len(there) - len(q) + 1):
            run = there[i : i + len(q)]
            if run == q:
                return at
            if len(q) >= 4 and len(set(q).intersection(run)) * 2 >= len(q):
                line = " ".join(run)
                if same_numbers(line, text) and difflib.SequenceMatcher(None, line, text).ratio() >= 0.85:
                    return at
    return None


def grounded(quote, said, deck):
    tok = said.tok
    parts = [tok(p) for p in re.split(r"\s*(?:\.\.\.|…)\s*", quote) if tok(p)]
    if len(parts) > 1:
        at, first = 0, None
        for p in parts:
            hits = said.places(p, at)
            if not hits:
                break
            first, at = hits[0] if first is None else first, hits[0] + len(p)
        else:
            return said.t[first], True, "speech"
    q = tok(quote)
    if not q:
        return None, False, None
    hits = said.places(q)
    if hits and (len(q) >= 4 or len(hits) <= 3):
        return said.t[hits[0]], True, "speech"
    if len(q) >= 4 and (near := said.nearest(q, 0.9)):
        return said.t[near[1]], True, "speech"
    seen = on_slides(q, deck, tok)
    return (seen, True, "slide") if seen is not None else (None, False, None)


def exact(text):
    return normal(text).split()


def test_fuzzy_and_cascade(spark, talks, decks):
    quotes = [(r.quote_id, r.talk_id, r.kind, r.quote) for r in catalog._talk_quotes(spark, SF).collect()]
    assert len({q for q, *_ in quotes}) == len(quotes) > 1000
    said, folded = ({k: Said(v, tok) for k, v in talks.items()} for tok in (tokens, exact))
    near = {r.quote_id: (r.pos, r.ratio) for r in catalog.q22_fuzzy_anchor(spark, SF).collect()}
    found = {r.quote_id: (r.t, r.grounded, r.source) for r in catalog.q24_cascade(spark, SF).collect()}
    assert set(found) == {q for q, *_ in quotes}
    for quote_id, talk, kind, quote in quotes[::3]:
        best = said[talk].nearest(tokens(quote), 0.9)
        assert near.get(quote_id) == (None if best is None else (best[1], pytest.approx(best[0]))), quote
        assert found[quote_id] == grounded(quote, folded[talk], decks[talk]), (kind, quote)


def test_slide_anchor(spark, decks):
    got = {(r.quote_id, r.talk_id): r.t for r in catalog.q23_slide_anchor(spark, SF).collect()}
    checked = 0
    for item in rows_of(spark, "benchmark")[::12]:
        words = tokens(item.text)
        for part in range(-(-len(words) // 9)):
            q = words[part * 9 : part * 9 + 9]
            for talk, deck in decks.items():
                assert got.get((item.item_id * 10_000 + part, talk)) == on_slides(q, deck), (item.item_id, part, talk)
                checked += 1
    assert got and checked > 100


def frames_of(spark):
    by = defaultdict(list)
    for r in sorted(rows_of(spark, "embeddings"), key=lambda r: r.vec_id):
        by[r.label].append(np.diff(np.asarray(r.embedding)) > 0)
    return {k: [b for b in v for _ in range(5)] for k, v in by.items()}


def apart(a, b):
    return sum(x != y for x, y in zip(a.tolist(), b.tolist())) / len(a)


def detected(bits, threshold=0.08, interval=2.0, floor=45.0):
    """[representative, source, [[first, last], ...]] in order of discovery."""
    out = []
    for i in range(len(bits) - 1):
        if apart(bits[i], bits[i + 1]) > 0.05:
            continue
        near = min(((apart(bits[c[0]], bits[i]), k) for k, c in enumerate(out)), default=(9, 0))
        if near[0] > threshold:
            out.append([i, "hash", [[i, i]]])
        elif out[near[1]][2][-1][1] >= i - 1:
            out[near[1]][2][-1][1] = i
        else:
            out[near[1]][2].append([i, i])
    tick = floor
    while floor and tick < len(bits) * interval:
        i = round(tick / interval)
        tick += floor
        if i >= len(bits) or any(a <= i <= b for c in out for a, b in c[2]):
            continue
        around = range(max(0, i - 2), min(len(bits) - 1, i + 2) + 1)
        calm = min(around, key=lambda j: (apart(bits[j], bits[j + 1]) if j + 1 < len(bits) else 0, j))
        near = min(((apart(bits[c[0]], bits[calm]), k) for k, c in enumerate(out)), default=(9, 0))
        if near[0] <= 0.05:
            out[near[1]][2] = sorted(out[near[1]][2] + [[calm, calm]])
        else:
            out.append([calm, "floor", [[calm, calm]]])
    return out


@pytest.mark.parametrize("name,options", [("q33_keyframes", {"floor": 0}), ("q34_floor_union", {"threshold": 0.3})])
def test_frames(spark, name, options):
    got = defaultdict(list)
    for r in sorted(catalog.queries()[name](spark, SF).collect(), key=lambda r: (r.talk_id, r.cand)):
        got[r.talk_id].append([r.rep_i, r.source, [[s.s, s.e] for s in r.spans]])
    assert dict(got) == {k: v for k, bits in frames_of(spark).items() if (v := detected(bits, **options))}


def test_capped_frames_and_their_times(spark):
    got, counts = defaultdict(list), {}
    for r in sorted(catalog.q35_capped(spark, SF).collect(), key=lambda r: (r.talk_id, r.ord)):
        got[r.talk_id].append((r.cand, r.rep_ms, [(s.start_ms, s.end_ms) for s in r.spans_ms]))
    for r in catalog.q35b_frame_stats(spark, SF).collect():
        counts[r.talk_id] = (r.hash_candidates, r.floor_candidates, r.candidates)
    for talk, bits in frames_of(spark).items():
        found = detected(bits)
        assert counts[talk] == (sum(c[1] == "hash" for c in found), sum(c[1] == "floor" for c in found), len(found))
        held = sorted(range(len(found)), key=lambda k: (-sum(b - a + 1 for a, b in found[k][2]), k))[:20]
        want = []
        for k in sorted(held, key=lambda k: (found[k][2][0][0], k)):
            a, b = max(found[k][2], key=lambda s: s[1] - s[0])
            want.append((k, int(((a + b) / 2 * 2.0 + 1.0) * 1000), [(x * 2000, (y + 1) * 2000) for x, y in found[k][2]]))
        assert got[talk] == want


def collapsed(deck):
    """Starting over after each merge."""
    slides = [{"id": i, "at": at, "idx": idx, "spans": list(spans), "words": {w for w in tokens(text or "") if len(w) > 1}, "builds": 0} for i, idx, at, spans, text in deck]
    slides.sort(key=lambda s: (s["at"], s["idx"]))
    again = True
    while again:
        again = False
        for a, b in zip(slides, slides[1:]):
            near = b["spans"][0][0] - a["spans"][-1][1] <= 15_000
            if near and len(a["words"]) >= 3 and b["words"] and len(b["words"]) >= len(a["words"]) and len(a["words"] & b["words"]) / len(a["words"]) >= 0.9:
                b.update(spans=sorted(b["spans"] + a["spans"]), at=min(a["at"], b["at"]), builds=b["builds"] + a["builds"] + 1)
                slides.remove(a)
                again = True
                break
    kept = []
    for s in slides:
        twin = [k for k in kept if len(s["words"]) >= 3 and k["words"] and len(s["words"] & k["words"]) / len(s["words"] | k["words"]) >= 0.92]
        if twin:
            twin[0].update(spans=sorted(twin[0]["spans"] + s["spans"]), at=min(s["at"], twin[0]["at"]))
        else:
            kept.append(s)
    for s in kept:
        joined = []
        for a, b in s["spans"]:
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        s.update(spans=joined, shown=sum(b - a for a, b in joined))
    return kept


def test_collapsed_decks(spark, decks):
    got = defaultdict(dict)
    for r in catalog.q37_build_collapse(spark, SF).collect():
        got[r.talk_id][r.slide_id] = (r.first_seen_ms, r.builds, [[s.start_ms, s.end_ms] for s in r.spans], r.on_screen_ms, r.times_returned, r.ord, r.name)
    for talk, deck in decks.items():
        kept = sorted(collapsed(deck), key=lambda s: (s["at"], s["id"]))
        assert got[talk] == {s["id"]: (s["at"], s["builds"], s["spans"], s["shown"], len(s["spans"]) - 1, n, f"s{n:03d}") for n, s in enumerate(kept, 1)}


def test_deduplicated_sources(spark):
    decks = defaultdict(list)
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id):
        source = re.search(r"(\d+)$", r.source or "")
        decks[int(source[1]) if source else None].append((r.doc_id, r.doc_id, r.doc_id * 60_000, [(r.doc_id * 60_000, r.doc_id * 60_000 + 20_000)], r.text))
    got = {r.slide_id: (r.talk_id, r.times_returned, r.on_screen_ms) for r in catalog.q38_greedy_dedup(spark, SF).collect()}
    assert got == {s["id"]: (k, len(s["spans"]) - 1, s["shown"]) for k, d in decks.items() for s in collapsed(d)}


HARD = (
    re.compile(r"\b\d+(?:\.\d+)?\s?(?:%|ms|s|sec|min|hours?|fps|gb|mb|kb|tb|k|b|x|×)\b", re.IGNORECASE),
    re.compile(r"\bv?\d+\.\d+(?:\.\d+)*\b"),
    re.compile(r"\b[A-Z][A-Z0-9]{1,5}\b"),
    re.compile(r"--[a-z][\w-]+"),
    re.compile(r"\b\w+(?:[-_]\w+)+\b"),
)


def test_verified_briefs(spark, talks, decks):
    segs, entries, marked = catalog._stamped(spark, SF, "test")
    marked, texts = marked.collect(), {r.talk_id: r.brief for r in brief.brief_text(marked, entries).collect()}
    rows = {r.talk_id: r for r in catalog.q78_verification(spark, SF).collect()}
    said = {k: Said(v) for k, v in talks.items()}
    seen = {}
    for r in marked:
        if r.quote:
            key = (r.talk_id, r.quote)
            if key not in seen:
                seen[key] = grounded(r.quote, said[r.talk_id], decks[r.talk_id])
            assert (r.t, r.grounded, r.source) == seen[key], r
        else:
            assert (r.t, r.grounded, r.source) == (None, False, None)
    for talk, segments in talks.items():
        own = [r for r in marked if r.talk_id == talk and r.quote]
        r = rows[talk]
        assert (r.quotes_total, r.quotes_grounded) == (len(own), sum(x.grounded for x in own))
        assert r.weak == (bool(own) and sum(x.grounded for x in own) / len(own) < 0.8)
        text = " ".join(t for *_, t in segments)
        count = Counter(m.strip() for p in HARD for m in p.findall(text))
        some = [k for k, n in count.items() if n >= 2 and len(k) >= 2]
        gone = sorted((k for k in some if k.casefold() not in texts[talk].casefold()), key=lambda k: (-count[k], k))
        assert r.token_recall == (round(1 - len(gone) / len(some), 3) if some else None)
        assert r.missing == ",".join(gone[:20])


def test_the_adapters_of_these_checks(spark, talks, decks):
    got = defaultdict(list)
    for r in sorted(adapters.segments(spark, SF).collect(), key=lambda r: (r.talk_id, r.seg_idx)):
        got[r.talk_id].append((r.start_ms, r.end_ms, r.text))
    assert got == talks
    assert {r.slide_id: (r.talk_id, r.idx) for r in adapters.slides(spark, SF).collect()} == {s[0]: (k, s[1]) for k, d in decks.items() for s in d}
