"""Anchors quotes: where in a talk was this said, or shown?"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import exact_tokens, same_digits, token_line
from lectern.operators.runs import Runs, numbers, segment_of
from lectern.sources.tables import materialize

SHORT_WORDS, SHORT_PLACES = 4, 3
RATIO_SPEECH, RATIO_SLIDE = 0.90, 0.85
#: Quotes of a talk that are looked up together, and rows of an Arrow batch of answers.
BLOCK, ROWS = 256, 10_000


def talk_tokens(segments: DataFrame, tokens: Callable[..., Column] = exact_tokens) -> DataFrame:
    """(talk_id, pos, tok, t): all tokens of a talk in order, each with its segment's start."""
    each = segments.select("talk_id", "seg_idx", F.col("start_ms").alias("t"), F.posexplode(tokens(F.col("text"))).alias("off", "tok"))
    pos = F.row_number().over(Window.partitionBy("talk_id").orderBy("seg_idx", "off")) - 1
    return each.select("talk_id", pos.cast("long").alias("pos"), "tok", "t")


def quote_tokens(quotes: DataFrame, col: str = "quote", tokens: Callable[..., Column] = exact_tokens, keys: tuple[str, ...] = ("quote_id",)) -> DataFrame:
    """(keys, m, off, tok)."""
    q = quotes.select(*keys, tokens(F.col(col)).alias("q")).where(F.size("q") > 0)
    return q.select(*keys, F.size("q").cast("long").alias("m"), F.posexplode("q").alias("off", "tok"))


def phrase_hits(qtokens: DataFrame, ttokens: DataFrame, keys: tuple[str, ...] = ("quote_id",), within: str = "talk_id", words: DataFrame | None = None) -> DataFrame:
    """(keys, talk_id, pos): every place where all tokens of a quote stand in order.

    If both sides have the column ``within``, a quote is looked for in its own
    talk (or deck). First only the quote's rarest token is joined, then the others at the
    places that it leaves: a stop word never makes candidates. Where ``words`` (talk_id, words) has each talk's
    tokens in one row, the others are read there.
    """
    own = [within] if within in qtokens.columns else []
    ids = list(dict.fromkeys([*keys, *own]))
    out = list(dict.fromkeys([*ids, "talk_id"]))
    counts = ttokens.join(qtokens.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("times"))
    rare = qtokens.join(counts, "tok", "left").groupBy(*ids).agg(F.min_by(F.struct("off", "tok", "m"), F.struct(F.coalesce("times", F.lit(0)), "off")).alias("r"))
    rare = rare.select(*ids, "r.off", "r.tok", "r.m")
    places = rare.join(ttokens.select(*dict.fromkeys([*own, "talk_id", "tok", "pos"])), [*own, "tok"]).select(*out, "m", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    if words is not None:
        wanted = qtokens.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_set(F.struct("off", "tok"))), lambda x: x["tok"]).alias("want"))
        hits = places.join(wanted, ids).join(words, "talk_id").where(F.slice("words", F.col("start").cast("int") + 1, F.col("m").cast("int")) == F.col("want"))
        return hits.select(*out, F.col("start").alias("pos"), "m")
    wanted = places.join(qtokens.select(*ids, "off", F.col("tok").alias("want")), ids).withColumn("pos", F.col("start") + F.col("off"))
    hits = wanted.join(ttokens.select("talk_id", "pos", F.col("tok").alias("there")), ["talk_id", "pos"]).where("want = there")
    return hits.groupBy(*out, "start", "m").agg(F.count("*").alias("same")).where("same = m").select(*out, F.col("start").alias("pos"), "m")


def fuzzy_candidates(qtokens: DataFrame, ttokens: DataFrame) -> DataFrame:
    """(quote_id, talk_id, m, start, run): runs of m tokens that hold at least half as many distinct tokens of the quote as it has tokens.

    Of a quote's d distinct tokens a run must hold c, so it holds one of the d - c + 1
    rarest. Only those are looked up; the runs around them are cut out of the talk's tokens, held in one row for each
    quote and talk that meet.
    """
    return _fuzzy_runs(qtokens, ttokens).drop("q")


def _fuzzy_runs(qtokens: DataFrame, ttokens: DataFrame, within: str = "talk_id", words: DataFrame | None = None) -> DataFrame:
    """``fuzzy_candidates`` with the quote's tokens in one string, q. A talk's tokens meet its quotes last and are never shuffled with them."""
    own = [within] if within in qtokens.columns else []
    quoted = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("off", "tok"))), lambda x: x["tok"]), " ")
    sets = qtokens.groupBy("quote_id", "m").agg(F.collect_set("tok").alias("toks"), quoted.alias("q"))
    each = sets.select("quote_id", "m", F.size("toks").alias("d"), F.explode("toks").alias("tok"))
    counts = ttokens.join(each.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("quote_id").orderBy(F.coalesce("times", F.lit(0)), "tok"))
    rare = each.join(counts, "tok", "left").withColumn("rank", rank).where("rank <= d - ceil(m / 2) + 1").select("quote_id", "m", "tok")
    if own:
        rare = rare.join(qtokens.select("quote_id", *own).distinct(), "quote_id")
    met = rare.join(ttokens.select(*dict.fromkeys([*own, "talk_id", "tok", "pos"])), [*own, "tok"]).groupBy("quote_id", "talk_id", "m").agg(F.collect_set("pos").alias("at"))
    if words is None:
        words = ttokens.groupBy("talk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("words"))
    met = met.join(sets.select("quote_id", "toks", "q"), "quote_id").join(words, "talk_id").where(F.size("words") >= F.col("m"))
    m = F.col("m").cast("int")
    around = F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), p.cast("int") - m + 1), F.least(p.cast("int"), F.size("words") - m)))
    runs = F.transform(F.array_distinct(F.flatten(around)), lambda s: F.struct(s.cast("long").alias("start"), F.slice("words", s + 1, m).alias("w")))
    held = F.filter(runs, lambda r: F.size(F.array_intersect(r["w"], F.col("toks"))) >= F.col("m") * 0.5)
    return met.select("quote_id", "talk_id", "m", "q", F.explode(held).alias("r")).select("quote_id", "talk_id", "m", "r.start", F.array_join("r.w", " ").alias("run"), "q")


def ratio(least: float = 0.0, autojunk: bool = True):
    """The share of matching characters, in order, of a run and a quote, as the sequence matcher of Python's library counts them;
    0 where its quick upper bounds already stay below ``least``. What it knows of a quote is kept for the next run."""

    @F.arrow_udf("double")
    def of(run: pa.Array, quote: pa.Array) -> pa.Array:
        out, match, last = [], difflib.SequenceMatcher(None, "", "", autojunk), None
        for a, b in zip(run.to_pylist(), quote.to_pylist()):
            if b != last:
                match.set_seq2(b)
                last = b
            match.set_seq1(a)
            near = match.real_quick_ratio() >= least and match.quick_ratio() >= least
            out.append(match.ratio() if near else 0.0)
        return pa.array(out, pa.float64())

    return of


def fuzzy_hits(qtokens: DataFrame, ttokens: DataFrame, least: float = RATIO_SPEECH, autojunk: bool = True, within: str = "talk_id", words: DataFrame | None = None) -> DataFrame:
    """(quote_id, talk_id, pos, ratio): the best run of each quote of four tokens or more; of equals the last.
    Quotes and runs must hold the same numbers."""
    long = qtokens.where(F.col("m") >= SHORT_WORDS)
    runs = _fuzzy_runs(long, ttokens, within, words).where(same_digits(F.col("run"), F.col("q")))
    scored = runs.withColumn("ratio", ratio(least, autojunk)("run", "q")).where(F.col("ratio") >= least)
    return scored.groupBy("quote_id", "talk_id").agg(F.max(F.struct("ratio", "start")).alias("x")).select("quote_id", "talk_id", F.col("x.start").alias("pos"), "x.ratio")


def ellipsis_hits(quotes: DataFrame, ttokens: DataFrame, tokens: Callable[..., Column] = exact_tokens) -> DataFrame:
    """(quote_id, talk_id, pos): where the first fragment stands of quotes whose fragments all stand in the talk one after another."""
    parts = F.split("quote", r"\s*(?:\.\.\.|…)\s*")
    own = ["talk_id"] if "talk_id" in quotes.columns else []
    each = quotes.select("quote_id", *own, F.posexplode(parts).alias("frag", "part"))
    toks = quote_tokens(each, "part", tokens, ("quote_id", *own, "frag"))
    # Fragments without tokens don't count; the others are numbered anew.
    dense = toks.select("quote_id", "frag").distinct()
    dense = dense.select("quote_id", "frag", (F.row_number().over(Window.partitionBy("quote_id").orderBy("frag")) - 1).alias("k"), F.count("*").over(Window.partitionBy("quote_id")).alias("of")).where("of > 1")
    hits = phrase_hits(toks.join(dense, ["quote_id", "frag"], "left_semi"), ttokens, ("quote_id", "frag")).join(dense, ["quote_id", "frag"])
    lists = hits.groupBy("quote_id", "talk_id", "of").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "m"))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("first"))

    def step(s, x):
        fits = (x["k"] == s["k"]) & (x["pos"] >= s["upto"])
        return F.struct(F.when(fits, x["pos"] + x["m"]).otherwise(s["upto"]).alias("upto"), F.when(fits, s["k"] + 1).otherwise(s["k"]).cast("int").alias("k"), F.when(fits & (s["k"] == 0), x["pos"]).otherwise(s["first"]).alias("first"))

    done = lists.select("quote_id", "talk_id", "of", F.aggregate("h", start, step).alias("s"))
    return done.where("s.k = of").select("quote_id", "talk_id", F.col("s.first").alias("pos"))


def slide_hits(qtokens: DataFrame, slides: DataFrame, tokens: Callable[..., Column] = exact_tokens) -> DataFrame:
    """(quote_id, talk_id, t): the first slide with a run that equals the quote, or, of four tokens or more, is near it."""
    key = F.struct("talk_id", "idx", F.col("first_seen_ms").alias("t"))
    words = slides.select(key.alias("talk_id"), F.col("talk_id").alias("deck"), tokens(F.col("ocr_text")).alias("words"))
    shown = words.select("talk_id", "deck", F.posexplode("words").alias("pos", "tok")).withColumn("pos", F.col("pos").cast("long"))
    # A quote that has a talk is held against the slides of its own.
    q = qtokens.withColumnRenamed("talk_id", "deck")
    words = words.select("talk_id", "words")
    exact = phrase_hits(q, shown, within="deck", words=words).select("quote_id", "talk_id")
    near = fuzzy_hits(q, shown, RATIO_SLIDE, within="deck", words=words).select("quote_id", "talk_id")
    found = exact.unionByName(near)
    return found.groupBy("quote_id", F.col("talk_id.talk_id").alias("talk")).agg(F.min_by(F.col("talk_id.t"), F.col("talk_id.idx")).alias("t")).select("quote_id", F.col("talk").alias("talk_id"), "t")


def _asked(quotes: DataFrame, *what: str) -> DataFrame:
    """(talk_id, block, x): a talk's quotes numbered by n, BLOCK of them in a block; x holds n and ``what``."""
    n = F.row_number().over(Window.partitionBy("talk_id").orderBy("quote_id")) - 1
    return quotes.withColumn("n", n).select("talk_id", F.floor(F.col("n") / BLOCK).alias("block"), F.struct("n", *what).alias("x"))


def _blocks(asked: DataFrame) -> DataFrame:
    """(talk_id, asked): a row for each block."""
    return asked.groupBy("talk_id", "block").agg(F.collect_list("x").alias("asked")).drop("block")


def _in_talk():
    """Of a block (talk_id, asked, segs), for each quote: (quote_id, talk_id, t, spoken, rest): its time, or else its tokens."""

    def of(row: Callable[[str], pa.Scalar]) -> Iterator[tuple]:
        quotes: dict[int, tuple] = {}
        x, said, talk = row("asked").values, row("segs").values, row("talk_id").as_py()
        for n, k, quote_id, toks in sorted(zip(*(x.field(f).to_pylist() for f in ("n", "k", "quote_id", "toks"))), key=lambda r: r[:2]):
            if k == 0:
                quotes[n] = (quote_id, tuple(toks.split()), [], numbers(toks))
            elif toks:
                quotes[n][2].append(tuple(toks.split()))
        times, segs = ([], []) if said is None else (said.field("t").to_pylist(), [s.split() for s in said.field("toks").to_pylist()])
        here = set(numbers(" ".join(w for s in segs for w in s)))
        able = {n: q for n, q in quotes.items() if q[1] and here.issuperset(q[3])}
        text = Runs([w for s in segs for w in s], [w for q in able.values() for w in (q[1], *q[2])])
        at, seg, near = {}, segment_of([len(s) for s in segs]), []
        for n, (_, q, parts, _) in able.items():
            place = text.in_order(parts) if len(parts) > 1 else None
            if place is None:
                places = list(islice(text.places(q), 1 if len(q) >= SHORT_WORDS else SHORT_PLACES + 1))
                place = places[0] if 0 < len(places) <= SHORT_PLACES else None
            if place is not None:
                at[n] = place
            elif len(q) >= SHORT_WORDS:
                near.append(n)
        for i, (_, place) in text.nearest([able[n][1] for n in near], [able[n][3] for n in near], RATIO_SPEECH).items():
            at[near[i]] = place
        for n, (quote_id, q, _, _) in quotes.items():
            if n in at:
                yield quote_id, talk, times[seg(at[n])], True, None
            else:
                yield quote_id, talk, None, False, " ".join(q) or None

    return of


def _on_slide():
    """Of a block and a slide (talk_id, idx, t, ids, rests, toks), for each quote that the slide shows: (quote_id, talk_id, idx, t)."""
    last, quotes, own = None, [], []

    def of(row: Callable[[str], pa.Scalar]) -> Iterator[tuple]:
        nonlocal last, quotes, own
        rests, toks = row("rests").as_py(), row("toks").as_py()
        if rests != last:
            last, quotes, own = rests, [tuple(q.split()) for q in rests.split("\n")], [numbers(q) for q in rests.split("\n")]
        here = set(numbers(toks))
        able = [i for i in range(len(quotes)) if here.issuperset(own[i])]
        if not able or not toks:
            return
        text = Runs(toks.split(), [quotes[i] for i in able])
        found = {i for i in able if next(text.places(quotes[i]), None) is not None}
        near = [i for i in able if i not in found and len(quotes[i]) >= SHORT_WORDS]
        found |= {near[k] for k in text.nearest([quotes[i] for i in near], [own[i] for i in near], RATIO_SLIDE, first=True)}
        if found:
            ids, talk, idx, t = (row(k).as_py() for k in ("ids", "talk_id", "idx", "t"))
            for i in sorted(found):
                yield ids[i], talk, idx, t

    return of


def _each(rows: DataFrame, make: Callable[[], Callable], schema: T.StructType) -> DataFrame:
    """What the function that ``make`` makes yields for each row, in Arrow batches."""
    arrow = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                out.extend(of(lambda k: batch.column(k)[i]))  # noqa: B023
                if len(out) >= ROWS:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def anchor(quotes: DataFrame, segments: DataFrame, slides: DataFrame, tokens: Callable[..., Column] = exact_tokens) -> DataFrame:
    """(quote_id, talk_id, t, grounded, source) for each quote (quote_id, talk_id, quote).

    In this order: fragments around an ellipsis, one after another; the exact
    words, unless fewer than four that stand in more than three places; a near
    run; a slide's text. A talk's tokens, in one row, meet its quotes in blocks of BLOCK; what a talk leaves is written and
    meets each slide of its deck, in blocks again. No token is shuffled by itself.
    """
    conf = quotes.sparkSession.conf
    kinds = {f.name: f.dataType for f in quotes.select("quote_id", "talk_id").schema}
    fields = lambda **more: T.StructType([T.StructField(k, v) for k, v in {**kinds, **more}.items()])
    # So many partitions as the session names, since the work isn't in the bytes that Spark would put together by.
    dealt = quotes.select("quote_id", "talk_id", "quote").repartition(int(conf.get("spark.sql.shuffle.partitions")), "talk_id")
    parts = F.split("quote", r"\s*(?:\.\.\.|…)\s*")
    each = _asked(dealt, "quote_id", F.when(F.size(parts) > 1, F.concat(F.array("quote"), parts)).otherwise(F.array("quote")).alias("parts"))
    each = each.select("talk_id", "block", "x.n", "x.quote_id", F.posexplode("x.parts").alias("k", "part"))
    asked = _blocks(each.select("talk_id", "block", F.struct("n", "k", "quote_id", token_line(F.col("part"), tokens).alias("toks")).alias("x")))
    said = segments.select("talk_id", F.struct("seg_idx", F.col("start_ms").cast("long").alias("t"), token_line(F.col("text"), tokens).alias("toks")).alias("s"))
    said = said.groupBy("talk_id").agg(F.array_sort(F.collect_list("s")).alias("segs"))
    spoken = _each(asked.join(said, "talk_id", "left"), _in_talk, fields(t=T.LongType(), spoken=T.BooleanType(), rest=T.StringType()))
    spoken = materialize(spoken, "spoken")

    left = _blocks(_asked(spoken.where("rest IS NOT NULL"), "quote_id", "rest"))
    left = left.select("talk_id", F.col("asked.quote_id").alias("ids"), F.array_join("asked.rest", "\n").alias("rests"))
    met = slides.select("talk_id", "idx", F.col("first_seen_ms").cast("long").alias("t"), "ocr_text").join(left, "talk_id")
    # Nothing is filtered by what a Python function has made: Spark would call it twice.
    met = met.select("talk_id", "idx", "t", "ids", "rests", token_line(F.col("ocr_text"), tokens).alias("toks"))
    shown = _each(met, _on_slide, fields(idx=T.LongType(), at=T.LongType()))
    shown = shown.groupBy("quote_id", "talk_id").agg(F.min_by("at", "idx").alias("at"), F.lit(True).alias("shown"))
    grounded = lambda t, source: (F.col("quote_id"), F.col("talk_id"), t, source.isNotNull().alias("grounded"), source.alias("source"))
    heard = spoken.where("rest IS NULL").select(*grounded(F.col("t"), F.when(F.col("spoken"), "speech")))
    seen = spoken.where("rest IS NOT NULL").select("quote_id", "talk_id").join(shown, ["quote_id", "talk_id"], "left")
    return heard.unionByName(seen.select(*grounded(F.col("at").alias("t"), F.when(F.col("shown"), "slide"))))
