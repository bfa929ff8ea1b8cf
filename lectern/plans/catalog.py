"""Every query over the talk operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as sc
from lectern.functions import schemas
from lectern.functions.text import digit_runs, fast_tokens, token_set
from lectern.operators import anchor, brief, cues, digest, frames, intervals, lineage, recall, report, slides, windows
from lectern.plans.sql import CHAPTERS, CHAPTER_WINDOWS, CUES, DOC_TOKENS, FRAMES, HARD_TOKENS, SEGMENTS, SLIDE_SUMS, SLIDES, TALK_QUOTES, TALK_TOKENS, TALKS, WORD_WINDOWS, with_parts
from lectern.sources import adapters, captions
from lectern.sources.tables import materialize, table

FLAGSHIP = "q19_phrase_hits"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _no_chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "talk_id long, idx long, title string, start_ms long, end_ms long")


def _no_segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "talk_id long, seg_idx long, start_ms long, end_ms long, words long, text string")


def _chapter_windows(spark: SparkSession, d: str, target: int = 10**9) -> DataFrame:
    segs = adapters.segments(spark, d)
    return windows.build_windows(adapters.talks(segs), segs, adapters.chapters(segs, d), target)


# Cues.


@query(with_parts(CUES, """
, r AS (SELECT *, sum(CASE WHEN text = prev THEN 0 ELSE 1 END) OVER t AS run
        FROM (SELECT *, lag(text) OVER (PARTITION BY talk_id ORDER BY ord) AS prev FROM cues) WINDOW t AS (PARTITION BY talk_id ORDER BY ord)),
u AS (SELECT *, max(end_ms) OVER (PARTITION BY talk_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_ms >= upto + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY talk_id ORDER BY ord) AS island FROM u)
SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY island) - 1 AS seg_idx, arg_min(start_ms, ord) AS start_ms, max(end_ms) AS end_ms, min(text) AS text
FROM i GROUP BY talk_id, island"""))  # fmt: skip
def q01_cue_flatten_runs(spark, d):
    return cues.merge_runs(adapters.repeated_cues(adapters.segments(spark, d)))


@query(with_parts(SEGMENTS, TALKS, """
, m AS (SELECT DISTINCT talk_id, unnest(range(start_ms // 60000, (end_ms - 1) // 60000 + 1)) AS minute FROM segs WHERE end_ms > start_ms)
SELECT t.talk_id, duration_ms // 60000 AS full_minutes, count(minute) AS spoken_minutes,
       CASE WHEN duration_ms // 60000 = 0 THEN 1.0 ELSE round(count(minute)::DOUBLE / (duration_ms // 60000), 3) END AS spoken_fraction
FROM talks t LEFT JOIN m ON m.talk_id = t.talk_id AND minute < duration_ms // 60000 GROUP BY t.talk_id, duration_ms"""))  # fmt: skip
def q02_coverage_fraction(spark, d):
    segs = adapters.segments(spark, d)
    return cues.spoken_fraction(segs, adapters.talks(segs))


@query(with_parts(SEGMENTS, """
SELECT talk_id, end_ms AS start_ms, nxt AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY talk_id ORDER BY seg_idx) AS nxt FROM segs) WHERE nxt - end_ms > 60000"""))
def q03_gap_list(spark, d):
    return cues.gaps(adapters.segments(spark, d))


@query(with_parts(SEGMENTS, TALKS, """
, g AS (SELECT talk_id, lead(start_ms) OVER (PARTITION BY talk_id ORDER BY seg_idx) - end_ms AS gap FROM segs),
s AS (SELECT talk_id, greatest(0, coalesce(max(gap), 0)) AS largest_gap_ms, count(*) FILTER (WHERE gap > 60000) AS n_gaps FROM g GROUP BY talk_id),
m AS (SELECT DISTINCT talk_id, unnest(range(start_ms // 60000, (end_ms - 1) // 60000 + 1)) AS minute FROM segs),
f AS (SELECT t.talk_id, CASE WHEN duration_ms // 60000 = 0 THEN 1.0 ELSE round(count(minute)::DOUBLE / (duration_ms // 60000), 3) END AS spoken_fraction
      FROM talks t LEFT JOIN m ON m.talk_id = t.talk_id AND minute < duration_ms // 60000 GROUP BY t.talk_id, duration_ms)
SELECT talk_id, spoken_fraction >= 0.5 AND largest_gap_ms <= 600000 AS ok, spoken_fraction, largest_gap_ms::BIGINT AS largest_gap_ms, n_gaps FROM f JOIN s USING (talk_id)"""))  # fmt: skip
def q04_gap_summary(spark, d):
    segs = adapters.segments(spark, d)
    return cues.coverage(segs, adapters.talks(segs))


# Windows.


@query(with_parts(SEGMENTS, TALKS, WORD_WINDOWS, """
SELECT talk_id, w_ord, printf('w%02d', w_ord) AS window_id, lo_ms::BIGINT AS lo_ms, hi_ms::BIGINT AS hi_ms,
       (SELECT coalesce(sum(words), 0)::BIGINT FROM segs s WHERE s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms) AS word_count
FROM word_windows w"""))  # fmt: skip
def q05_word_windows(spark, d):
    segs = adapters.segments(spark, d)
    rows = segs.groupBy("talk_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "words"))).alias("segs"), F.max("end_ms").alias("end"))
    each = rows.select("talk_id", "segs", F.posexplode(windows.word_spans(F.col("segs"), F.col("end"), 120)).alias("i", "s"))
    n = F.col("i") + 1
    return each.select("talk_id", n.cast("long").alias("w_ord"), F.format_string("w%02d", n).alias("window_id"), F.col("s.lo").alias("lo_ms"), F.col("s.hi").alias("hi_ms"), windows.words_in(F.col("segs"), F.col("s.lo"), F.col("s.hi")).alias("word_count"))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, """
SELECT talk_id, w_ord, printf('w%02d', w_ord) AS window_id, lo_ms, hi_ms, title,
       (SELECT coalesce(sum(words), 0)::BIGINT FROM segs s WHERE s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms) AS word_count
FROM chapter_windows w"""))  # fmt: skip
def q06_chapter_windows(spark, d):
    return _chapter_windows(spark, d)


@query("""
SELECT o_orderkey AS talk_id, i + 1 AS w_ord, printf('w%02d', i + 1) AS window_id, round(i * dur / n)::BIGINT AS lo_ms, round((i + 1) * dur / n)::BIGINT AS hi_ms
FROM (SELECT *, unnest(range(0, n)) AS i FROM (
  SELECT o_orderkey, dur, greatest(1, ceil(dur / 300000)::BIGINT) AS n FROM (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS dur FROM orders)))""")  # fmt: skip
def q07_time_fallback_windows(spark, d):
    talks = table(spark, d, "orders").select(F.col("o_orderkey").alias("talk_id"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("duration_ms"))
    return windows.build_windows(talks, _no_segments(spark), _no_chapters(spark)).select("talk_id", "w_ord", "window_id", "lo_ms", "hi_ms")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, """
, sized AS (SELECT *, (SELECT coalesce(sum(words), 0) FROM segs s WHERE s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms) AS n FROM chapter_windows w),
big AS (SELECT *, ceil(n / 60)::BIGINT AS parts FROM sized WHERE n > 1.6 * 60),
ins AS (SELECT b.talk_id, b.w_ord, b.parts, b.lo_ms, b.hi_ms, s.end_ms, s.words, row_number() OVER (PARTITION BY b.talk_id, b.w_ord ORDER BY s.seg_idx) AS k,
               sum(s.words) OVER (PARTITION BY b.talk_id, b.w_ord)::DOUBLE / b.parts AS share
        FROM big b JOIN segs s ON s.talk_id = b.talk_id AND s.start_ms >= b.lo_ms AND s.start_ms < b.hi_ms),
walk AS (
  SELECT talk_id, w_ord, 0::BIGINT AS k, 0::BIGINT AS acc, any_value(share) AS nxt, 0::BIGINT AS cuts, any_value(lo_ms) AS prev, FALSE AS cut FROM ins GROUP BY ALL
  UNION ALL
  SELECT i.talk_id, i.w_ord, i.k, acc + i.words, CASE WHEN c THEN nxt + i.share ELSE nxt END, CASE WHEN c THEN cuts + 1 ELSE cuts END, CASE WHEN c THEN i.end_ms ELSE prev END, c
  FROM (SELECT i.*, w.acc, w.nxt, w.cuts, w.prev, (w.acc + i.words >= w.nxt AND w.cuts < i.parts - 1 AND w.prev < i.end_ms AND i.end_ms < i.hi_ms) AS c
        FROM walk w JOIN ins i ON i.talk_id = w.talk_id AND i.w_ord = w.w_ord AND i.k = w.k + 1) i),
edges AS (SELECT talk_id, w_ord, prev AS lo FROM walk WHERE cut UNION ALL SELECT talk_id, w_ord, lo_ms FROM sized),
cutup AS (SELECT e.talk_id, e.w_ord, lo, coalesce(lead(lo) OVER p, z.hi_ms) AS hi, row_number() OVER p AS j, count(*) OVER (PARTITION BY e.talk_id, e.w_ord) AS of, title
          FROM edges e JOIN sized z USING (talk_id, w_ord) WINDOW p AS (PARTITION BY e.talk_id, e.w_ord ORDER BY lo))
SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY w_ord, j) AS w_ord, lo::BIGINT AS lo_ms, hi::BIGINT AS hi_ms, CASE WHEN of > 1 THEN title || ' (' || j || ')' ELSE title END AS title,
       (SELECT coalesce(sum(words), 0)::BIGINT FROM segs s WHERE s.talk_id = c.talk_id AND s.start_ms < hi AND s.end_ms > lo) AS word_count
FROM cutup c""", recursive=True))  # fmt: skip
def q08_quantile_split(spark, d):
    return _chapter_windows(spark, d, 60).drop("window_id")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, """
SELECT w.talk_id, printf('w%02d', w_ord) AS window_id, sum(words)::BIGINT AS word_count
FROM chapter_windows w JOIN segs s ON s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms GROUP BY ALL"""))
def q09_window_word_count(spark, d):
    return intervals.window_words(adapters.segments(spark, d), _chapter_windows(spark, d))


# Slides and windows.


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, "SELECT talk_id, slide_id, printf('w%02d', w_ord) AS window_id, w_ord, overlap_ms::BIGINT AS overlap_ms FROM sums"))
def q10_overlap_sum(spark, d):
    return intervals.overlap_sums(adapters.slides(spark, d), _chapter_windows(spark, d))


_PRIMARY = """
, best AS (SELECT talk_id, slide_id, arg_min(w_ord, (-overlap_ms, w_ord)) AS w_ord FROM sums GROUP BY ALL),
near AS (SELECT s.talk_id, s.slide_id, arg_min(w.w_ord, (abs(2 * first_seen_ms - lo_ms - hi_ms), w.w_ord)) AS w_ord
         FROM slides s JOIN chapter_windows w USING (talk_id) WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.talk_id = s.talk_id AND b.slide_id = s.slide_id) GROUP BY ALL),
homes AS (SELECT * FROM best UNION ALL SELECT * FROM near),
ctx AS (SELECT u.talk_id, u.slide_id, u.w_ord FROM sums u JOIN homes h USING (talk_id, slide_id) JOIN slides s USING (talk_id, slide_id)
        WHERE u.w_ord <> h.w_ord AND u.overlap_ms >= greatest(8000, 0.15 * on_screen_ms)),
assigned AS (SELECT *, 'primary' AS role FROM homes UNION ALL SELECT *, 'context' FROM ctx)
"""


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, "SELECT talk_id, slide_id, printf('w%02d', w_ord) AS window_id FROM homes"))
def q11_primary(spark, d):
    return intervals.assign_slides(adapters.slides(spark, d), _chapter_windows(spark, d)).where("role = 'primary'").select("talk_id", "slide_id", "window_id")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, "SELECT talk_id, slide_id, printf('w%02d', w_ord) AS window_id FROM ctx"))
def q12_context(spark, d):
    return intervals.assign_slides(adapters.slides(spark, d), _chapter_windows(spark, d)).where("role = 'context'").select("talk_id", "slide_id", "window_id")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, "SELECT talk_id, slide_id, printf('w%02d', w_ord) AS window_id FROM near"))
def q13_nearest_fallback(spark, d):
    found = intervals.assign_slides(adapters.slides(spark, d), _chapter_windows(spark, d))
    return found.where("role = 'primary' and overlap_ms = 0").select("talk_id", "slide_id", "window_id")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, """
SELECT talk_id, printf('w%02d', w_ord) AS window_id, role, string_agg(slide_id::VARCHAR, ',' ORDER BY first_seen_ms, idx) AS slide_ids
FROM assigned JOIN slides USING (talk_id, slide_id) GROUP BY ALL"""))
def q14_bridge_sorted(spark, d):
    s = adapters.slides(spark, d)
    return intervals.window_slides(intervals.assign_slides(s, _chapter_windows(spark, d)), s).withColumn("slide_ids", F.array_join(F.transform("slide_ids", lambda x: x.cast("string")), ","))


_EVENT_SPANS = """WITH spans AS (SELECT user_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT AS end_ms FROM events),
m AS (SELECT *, CASE WHEN upto IS NULL OR start_ms > upto + 1 THEN 1 ELSE 0 END AS new
      FROM (SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms) AS island FROM m),
fused AS (SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY user_id, island)"""


def _event_spans(spark, d):
    start = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select("user_id", start.alias("start_ms"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"))


@query(_EVENT_SPANS + "SELECT * FROM fused")
def q15_span_fusion(spark, d):
    return intervals.fuse(_event_spans(spark, d), ("user_id",))


@query(_EVENT_SPANS + "SELECT user_id, sum(end_ms - start_ms)::BIGINT AS on_screen_ms, count(*) - 1 AS times_returned FROM fused GROUP BY user_id")
def q15b_span_totals(spark, d):
    return intervals.on_screen(intervals.fuse(_event_spans(spark, d), ("user_id",)), ("user_id",))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, """
, ins AS (SELECT w.talk_id, w.w_ord, w.lo_ms, s.start_ms, s.words, s.text, row_number() OVER (PARTITION BY w.talk_id, w.w_ord ORDER BY s.seg_idx) AS k
          FROM chapter_windows w JOIN segs s ON s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms),
walk AS (SELECT talk_id, w_ord, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS line FROM ins GROUP BY ALL
  UNION ALL SELECT i.talk_id, i.w_ord, i.k, CASE WHEN w.n + i.words >= 22 THEN 0 ELSE w.n + i.words END, CASE WHEN w.n = 0 THEN w.line + 1 ELSE w.line END
  FROM walk w JOIN ins i ON i.talk_id = w.talk_id AND i.w_ord = w.w_ord AND i.k = w.k + 1),
lines AS (SELECT i.talk_id, i.w_ord, w.line, arg_min(i.start_ms, i.k) AS since, any_value(lo_ms) AS lo_ms, sum(words) AS words, string_agg(text, ' ' ORDER BY i.k) AS text
          FROM walk w JOIN ins i USING (talk_id, w_ord, k) GROUP BY ALL)
SELECT talk_id, printf('w%02d', w_ord) AS window_id, line - 1 AS line, CASE WHEN words < 22 AND since = 0 THEN lo_ms ELSE since END AS start_ms, text FROM lines""", recursive=True))  # fmt: skip
def q16_line_pack(spark, d):
    return windows.pack_lines(adapters.segments(spark, d), _chapter_windows(spark, d))


# Tokens, phrases, anchors.


@query(with_parts(DOC_TOKENS, "SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs FROM doc_tokens GROUP BY tok"))
def q17_tokens(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(fast_tokens(F.col("text"))).alias("tok"))
    per_doc = each.groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    return per_doc.groupBy("tok").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(with_parts(DOC_TOKENS, ", s AS (SELECT DISTINCT doc_id, tok FROM doc_tokens WHERE length(tok) >= 2) SELECT doc_id, count(*) AS n, min(tok) AS least FROM s GROUP BY doc_id"))
def q18_token_sets(spark, d):
    s = table(spark, d, "documents").select("doc_id", token_set(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("least")).where("n > 0")


_PHRASES = """, qt AS (SELECT item_id AS quote_id, part, m, off, list_extract(q, off::INTEGER + 1) AS tok FROM (
  SELECT item_id, part, q, len(q) AS m, unnest(range(0, len(q))) AS off FROM (SELECT item_id, part, w[part * {n} + 1 : part * {n} + {n}] AS q FROM (
  SELECT item_id, w, unnest(range(0, (len(w) + {n} - 1) // {n})) AS part FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark))))),
hits AS (SELECT quote_id, part, doc_id, pos - off AS pos, m FROM qt JOIN doc_tokens USING (tok) GROUP BY quote_id, part, doc_id, pos - off, m HAVING count(*) = m)"""


def _benchmark_parts(spark, d, n: int) -> DataFrame:
    """(quote_id, part, q): each whole benchmark text in consecutive quotes of n tokens, the last one shorter."""
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), fast_tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    parts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / n).cast("int"))
    return w.select("quote_id", "w", F.explode(parts).alias("part")).select("quote_id", F.col("part").cast("long").alias("part"), F.slice("w", F.col("part") * n + 1, n).alias("q"))


def _benchmark_hits(spark, d, n: int) -> DataFrame:
    qt = _benchmark_parts(spark, d, n).select("quote_id", "part", F.size("q").cast("long").alias("m"), F.posexplode("q").alias("off", "tok"))
    tt = table(spark, d, "documents").select(F.col("doc_id").alias("talk_id"), F.posexplode(fast_tokens(F.col("text"))).alias("pos", "tok"))
    return anchor.phrase_hits(qt, tt.withColumn("pos", F.col("pos").cast("long")), ("quote_id", "part")).withColumnRenamed("talk_id", "doc_id")


@query(with_parts(DOC_TOKENS, _PHRASES.format(n=8), " SELECT quote_id, part, doc_id, pos, m FROM hits"))
def q19_phrase_hits(spark, d):
    return _benchmark_hits(spark, d, 8)


@query(with_parts(DOC_TOKENS, _PHRASES.format(n=3), " SELECT quote_id, part, doc_id, count(*) AS places, min(pos) AS pos, count(*) > 3 AS ambiguous FROM hits GROUP BY ALL"))
def q20_short_ambiguity(spark, d):
    places = F.count("*")
    return _benchmark_hits(spark, d, 3).groupBy("quote_id", "part", "doc_id").agg(places.alias("places"), F.min("pos").alias("pos"), (places > anchor.SHORT_PLACES).alias("ambiguous"))


@query(with_parts(SEGMENTS, TALK_TOKENS, TALK_QUOTES, """
, ft AS (SELECT quote_id, talk_id, k, len(f) AS m, unnest(range(0, len(f))) AS off, unnest(f) AS tok FROM (
   SELECT quote_id, talk_id, 0 AS k, regexp_extract_all(lower(string_split(quote, ' … ')[1]), '[\\p{L}\\p{N}]+') AS f FROM quotes WHERE kind = 'ellipsis'
   UNION ALL SELECT quote_id, talk_id, 1, regexp_extract_all(lower(string_split(quote, ' … ')[2]), '[\\p{L}\\p{N}]+') FROM quotes WHERE kind = 'ellipsis')),
h AS (SELECT quote_id, talk_id, k, m, pos - off AS pos FROM ft JOIN talk_tokens USING (talk_id, tok) GROUP BY quote_id, talk_id, k, m, pos - off HAVING count(*) = m),
a AS (SELECT quote_id, talk_id, min(pos) AS pos, any_value(m) AS m FROM h WHERE k = 0 GROUP BY ALL)
SELECT a.quote_id, a.talk_id, a.pos FROM a WHERE EXISTS (SELECT 1 FROM h WHERE h.quote_id = a.quote_id AND h.talk_id = a.talk_id AND k = 1 AND h.pos >= a.pos + a.m)"""))  # fmt: skip
def q21_ellipsis(spark, d):
    q = _talk_quotes(spark, d).where("kind = 'ellipsis'")
    return anchor.ellipsis_hits(q, anchor.talk_tokens(adapters.segments(spark, d), fast_tokens), fast_tokens)


def _talk_quotes(spark, d) -> DataFrame:
    """Quotes of each talk's own turns, cut from every run of twelve words, and changed ones."""
    w = fast_tokens(F.col("text"))
    t = table(spark, d, "conversations").select("conv_id", "turn", w.alias("all")).where(F.size("all") >= 12)
    t = t.select("conv_id", "turn", "all", F.explode(F.sequence(F.lit(0), F.floor(F.size("all") / 12).cast("int") - 1)).alias("part"))
    t = t.select("conv_id", "turn", "part", F.slice("all", F.col("part") * 12 + 1, 12).alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), part(2, 8).alias("quote")),
        F.struct(F.lit("ellipsis").alias("kind"), F.concat(part(1, 4), F.lit(" … "), part(7, 4)).alias("quote")),
        F.struct(F.lit("fuzzy").alias("kind"), F.concat(part(1, 5), F.lit(" "), F.element_at("w", 6), F.lit("x "), part(7, 4)).alias("quote")),
        F.struct(F.lit("digits").alias("kind"), F.concat(part(1, 5), F.lit(" 40 "), part(7, 4)).alias("quote")),
    )
    each = t.select("conv_id", "turn", "part", F.posexplode(kinds).alias("i", "x"))
    quote_id = (F.col("conv_id").cast("long") * 1000 + F.col("turn")) * 40000 + F.col("part") * 4 + F.col("i")
    return each.select(quote_id.alias("quote_id"), F.col("conv_id").alias("talk_id"), "x.kind", "x.quote")


def _talk_side(spark, d):
    return anchor.talk_tokens(adapters.segments(spark, d), fast_tokens), anchor.quote_tokens(_talk_quotes(spark, d), "quote", fast_tokens, ("quote_id", "talk_id"))


@query()
def q22_fuzzy_anchor(spark, d):
    tt, qt = _talk_side(spark, d)
    return anchor.fuzzy_hits(qt, tt)


@query()
def q23_slide_anchor(spark, d):
    parts = _benchmark_parts(spark, d, 9)
    b = parts.select((F.col("quote_id").cast("long") * 10000 + F.col("part")).alias("quote_id"), F.array_join("q", " ").alias("quote"))
    return anchor.slide_hits(anchor.quote_tokens(b, "quote", fast_tokens), adapters.slides(spark, d), fast_tokens)


@query()
def q24_cascade(spark, d):
    return anchor.anchor(_talk_quotes(spark, d).select("quote_id", "talk_id", "quote"), adapters.segments(spark, d), adapters.slides(spark, d))


@query(with_parts(SEGMENTS, TALK_TOKENS, TALK_QUOTES, """
, q AS (SELECT quote_id, talk_id, regexp_extract_all(lower(quote), '[\\p{L}\\p{N}]+') AS w FROM quotes WHERE kind = 'fuzzy'),
qt AS (SELECT DISTINCT quote_id, talk_id, len(w) AS m, unnest(w) AS tok FROM q), n AS (SELECT talk_id, count(*) AS n FROM talk_tokens GROUP BY talk_id),
s AS (SELECT DISTINCT quote_id, talk_id, m, tok, unnest(range(greatest(0, pos - m + 1), least(pos, n - m) + 1)) AS start FROM qt JOIN talk_tokens USING (talk_id, tok) JOIN n USING (talk_id))
SELECT quote_id, talk_id, m, start FROM s GROUP BY ALL HAVING count(*) >= 0.5 * m"""))  # fmt: skip
def q25_fuzzy_candidates(spark, d):
    tt = anchor.talk_tokens(adapters.segments(spark, d), fast_tokens)
    qt = anchor.quote_tokens(_talk_quotes(spark, d).where("kind = 'fuzzy'"), "quote", fast_tokens, ("quote_id", "talk_id"))
    return anchor.fuzzy_candidates(qt, tt).drop("run")


@query("""SELECT doc_id, len(r) AS n, array_to_string(list_sort(r), ',') AS digits FROM (SELECT doc_id, regexp_extract_all(text, '\\p{Nd}+') AS r FROM documents)""")
def q26_digit_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", digit_runs(F.col("text")).alias("r")).select("doc_id", F.size("r").cast("long").alias("n"), F.array_join("r", ",").alias("digits"))


@query(with_parts(HARD_TOKENS, "SELECT doc_id, family, token, count(*) AS n FROM hard GROUP BY ALL"))
def q27_hard_tokens(spark, d):
    found = recall.hard_tokens(table(spark, d, "documents"), "doc_id")
    return found.groupBy("doc_id", "family", "token").agg(F.count("*").alias("n"))


_RECALL = """, e AS (SELECT doc_id, token, count(*) AS n FROM hard GROUP BY ALL HAVING count(*) >= 2 AND length(token) >= 2),
x AS (SELECT e.*, NOT contains(lower(b.text), lower(token)) AS gone FROM e JOIN documents b ON b.doc_id = (e.doc_id + 1) % (SELECT count(*) FROM documents))"""


def _recall(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    briefs = docs.join(F.broadcast(n)).select(F.pmod(F.col("doc_id") - 1, F.col("n")).alias("doc_id"), F.col("text").alias("brief"))
    return recall.recall(docs, briefs, "doc_id")


@query(with_parts(HARD_TOKENS, _RECALL, ", r AS (SELECT doc_id, round(1 - count(*) FILTER (WHERE gone)::DOUBLE / count(*), 3) AS recall FROM x GROUP BY doc_id) SELECT d.doc_id, recall FROM documents d LEFT JOIN r USING (doc_id)"))
def q28_recall(spark, d):
    return _recall(spark, d).select("doc_id", "recall")


@query(with_parts(HARD_TOKENS, _RECALL, """, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS r FROM x WHERE gone),
m AS (SELECT doc_id, string_agg(token, ',' ORDER BY r) AS missing FROM t WHERE r <= 20 GROUP BY doc_id) SELECT doc_id, coalesce(missing, '') AS missing FROM documents LEFT JOIN m USING (doc_id)"""))
def q29_missing_top20(spark, d):
    return _recall(spark, d).select("doc_id", F.array_join("missing", ",").alias("missing"))


# Frames.


@query("""SELECT vec_id, array_to_string(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), '') AS bits FROM embeddings""")
def q30_dhash(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.array_join(F.transform(sc.dhash(F.col("embedding"), 64), lambda b: b.cast("int").cast("string")), "").alias("bits"))


_PAIRS = """, p AS (SELECT talk_id, i, bits, lead(bits) OVER (PARTITION BY talk_id ORDER BY i) AS nxt FROM frames),
dist AS (SELECT talk_id, i, list_sum(list_transform(range(1, len(bits) + 1), lambda j: CASE WHEN bits[j] <> nxt[j] THEN 1 ELSE 0 END)) AS differ, len(bits) AS of FROM p WHERE nxt IS NOT NULL)"""


@query(with_parts(FRAMES, _PAIRS, "SELECT talk_id, i, differ::DOUBLE / of <= 0.05 AS settled FROM dist"))
def q31_settled(spark, d):
    return frames.settled(adapters.frames(spark, d)).select("talk_id", "i", "settled")


@query(with_parts(FRAMES, _PAIRS, "SELECT talk_id, i, differ::BIGINT AS differ FROM dist"))
def q32_hamming(spark, d):
    s = frames.settled(adapters.frames(spark, d))
    return s.select("talk_id", "i", F.round(F.col("distance") * 63).cast("long").alias("differ"))


@query()
def q33_keyframes(spark, d):
    return frames.candidates(adapters.frames(spark, d), floor_s=0)


@query()
def q34_floor_union(spark, d):
    return frames.candidates(adapters.frames(spark, d), threshold=0.3)


@query()
def q35_capped(spark, d):
    return frames.timed(frames.capped(frames.candidates(adapters.frames(spark, d)), most=20))


@query()
def q35b_frame_stats(spark, d):
    return frames.stats(frames.candidates(adapters.frames(spark, d)))


# Slides.


@query(with_parts(DOC_TOKENS, """, l AS (SELECT doc_id, list_sort(list_distinct(list(tok))) AS l FROM doc_tokens WHERE length(tok) >= 2 GROUP BY doc_id HAVING count(DISTINCT tok) >= 3),
c AS (SELECT doc_id, l, min(doc_id) OVER (PARTITION BY l) AS head FROM l), s AS (SELECT doc_id, len(l) AS n, unnest(l) AS tok FROM c WHERE doc_id = head),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS common FROM s x JOIN s y ON x.tok = y.tok AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, common::DOUBLE / (n_a + n_b - common) AS jaccard FROM p WHERE common::DOUBLE / (n_a + n_b - common) >= 0.92 UNION ALL SELECT head, doc_id, 1.0 FROM c WHERE doc_id <> head"""))  # fmt: skip
def q36_jaccard_pairs(spark, d):
    """Pairs between classes of equal token sets, and each member with the least one of its class."""
    return slides.jaccard_pairs(table(spark, d, "documents").select("doc_id", token_set(F.col("text")).alias("toks")), id_col="doc_id")


@query()
def q37_build_collapse(spark, d):
    return slides.renumber(slides.collapse(adapters.slides(spark, d)))


@query()
def q38_greedy_dedup(spark, d):
    """Documents of one source as a deck, in which copies of earlier ones go into those."""
    return slides.collapse(_source_slides(spark, d)).select("talk_id", "slide_id", "times_returned", "on_screen_ms")


def _source_slides(spark, d) -> DataFrame:
    at = F.col("doc_id") * 60_000
    span = F.array(F.struct(at.alias("start_ms"), (at + 20_000).alias("end_ms")))
    docs = table(spark, d, "documents")
    return docs.select(F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("talk_id"), F.col("doc_id").alias("slide_id"), F.col("doc_id").alias("idx"), at.alias("first_seen_ms"), span.alias("spans"), F.col("text").alias("ocr_text"))


@query(with_parts(SLIDES, """
, t AS (SELECT talk_id, slide_id, idx, spans, list_distinct(list_filter(regexp_extract_all(lower(ocr_text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS a FROM slides),
n AS (SELECT *, lead(slide_id) OVER w AS next_id, lead(a) OVER w AS b, lead(spans[1].start_ms) OVER w - spans[-1].end_ms AS gap FROM t WINDOW w AS (PARTITION BY talk_id ORDER BY idx))
SELECT talk_id, slide_id, next_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) END AS contained,
       coalesce(len(a) >= 3 AND len(b) > 0 AND gap <= 15000 AND len(list_intersect(a, b))::DOUBLE / len(a) >= 0.9 AND len(b) >= len(a), FALSE) AS is_build
FROM n WHERE next_id IS NOT NULL"""))  # fmt: skip
def q39_adjacent_containment(spark, d):
    return slides.adjacent_containment(adapters.slides(spark, d))


_CODE = r"""WITH c AS (SELECT doc_id, source, text, length(text) AS chars, list_filter(regexp_split_to_array(text, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
      lambda x: NOT regexp_full_match(x, '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*')) AS l FROM documents),
k AS (SELECT *, len(l) > 0 AND (len(list_filter(l, lambda x: regexp_matches(x, '^(?:\s{2,}\S|def |class |import |func |const |let |var |#include|for\s*\(|if\s*\()')))::DOUBLE / len(l) > 0.25
      OR len(regexp_extract_all(text, '[{}();=<>\[\]|&]'))::DOUBLE / length(text) > 0.05) AS code FROM c)"""


@query(_CODE + " SELECT doc_id, coalesce(code, FALSE) AS code FROM k")
def q40_code_like(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.code_like(F.col("text")).alias("code"))


@query(_CODE + " SELECT doc_id, CASE WHEN chars >= 200 AND NOT code THEN 'text' ELSE 'image' END AS route FROM k")
def q41_route(spark, d):
    return digest.routed(table(spark, d, "documents").select("doc_id", F.col("text").alias("ocr_text"))).select("doc_id", "route")


@query(_CODE + """, r AS (SELECT doc_id, source, chars, CASE WHEN chars >= 200 AND NOT code THEN 'text' ELSE 'image' END AS route FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY source, route ORDER BY chars DESC, doc_id) AS rk FROM r)
SELECT source, doc_id AS slide_id, CASE WHEN route = 'image' AND rk > 3 THEN 'text' ELSE route END AS route FROM n""")
def q42_image_budget(spark, d):
    docs = table(spark, d, "documents").select(F.lit(0).alias("talk_id"), F.col("source").alias("window_id"), F.col("doc_id").alias("slide_id"), F.col("text").alias("ocr_text"), F.length("text").alias("on_screen_ms"), F.col("doc_id").alias("first_seen_ms"))
    return digest.image_budget(digest.routed(docs), most=3).select(F.col("window_id").alias("source"), "slide_id", "route")


@query(r"""SELECT d.doc_id AS slide_id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE coalesce(nullif(trim(string_split(trim(text), chr(10))[1]), ''), 'Slide ' || d.doc_id) END AS heading,
CASE WHEN l.doc_id IS NOT NULL THEN 'toxic ' || l.toxic ELSE '' END AS what_it_shows, l.doc_id IS NULL AS placeholder FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q43_placeholder_join(spark, d):
    s = table(spark, d, "documents").select(F.lit(0).alias("talk_id"), F.col("doc_id").alias("slide_id"), F.col("doc_id").alias("idx"), F.col("text").alias("ocr_text"))
    e = table(spark, d, "labels").select(F.lit(0).alias("talk_id"), F.col("doc_id").alias("slide_id"), F.lit(1).alias("w_ord"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("heading"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("what_it_shows"), F.lit("").alias("significance"))
    return digest.with_entries(s, e).select("slide_id", "heading", "what_it_shows", "placeholder")


@query("""SELECT path, count(*) FILTER (WHERE quote <> '') AS quotes_total, count(*) FILTER (WHERE quote <> '' AND length(quote) % 2 = 0) AS quotes_grounded FROM (
SELECT 'takeaways' AS path, text AS quote FROM benchmark UNION ALL SELECT 'points', CASE WHEN turn % 3 = 0 THEN '' ELSE text END FROM conversations) GROUP BY path""")
def q44_quote_union_totals(spark, d):
    a = table(spark, d, "benchmark").select(F.lit(0).cast("long").alias("talk_id"), F.col("item_id").alias("ord"), F.col("text").alias("quote"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("quote"))
    both = digest.quote_union(takeaways=a, points=b).withColumn("grounded", F.length("quote") % 2 == 0)
    return digest.quote_totals(both, "path")


# Batches and caches.

_ITEMS = """WITH items AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'done' WHEN quality = 0 THEN 'failed' END AS status,
CASE WHEN quality = 0 AND toxic = 1 THEN 'FAILED_FINAL' WHEN quality = 0 THEN 'FAILED_RETRYABLE' END AS error_class, source FROM documents LEFT JOIN labels USING (doc_id))"""


def _items(spark, d) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed")
    err = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "FAILED_FINAL").when(F.col("quality") == 0, "FAILED_RETRYABLE")
    return j.select("doc_id", status.alias("status"), err.alias("error_class"), "source")


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'FAILED_FINAL' ELSE 'FAILED_RETRYABLE' END AS error_class FROM events""")
def q45_error_class(spark, d):
    said = F.when(F.col("event_type") == "error", "ERROR: [x] PRIVATE VIDEO. Sign in").when(F.col("event_type") == "view", "this video is not available in your country").otherwise(F.concat(F.lit("HTTP Error 503 "), "props"))
    return table(spark, d, "events").select("event_id", sc.error_class(said).alias("error_class"))


@query(_ITEMS + " SELECT doc_id FROM items WHERE status IS DISTINCT FROM 'done' AND error_class IS DISTINCT FROM 'FAILED_FINAL'")
def q46_resume(spark, d):
    return lineage.to_resume(_items(spark, d)).select("doc_id")


@query(_ITEMS + " SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, (CASE WHEN count(*) FILTER (WHERE status = 'done') = count(*) THEN 0 ELSE 2 END)::BIGINT AS exit_code FROM items GROUP BY source")
def q47_batch_summary(spark, d):
    return lineage.batch_summary(_items(spark, d), "source")


_RUNS = """WITH runs AS (SELECT o_custkey AS talk_id, (['fetch', 'slides', 'transcript', 'align', 'synthesize', 'verify', 'render'])[(o_orderkey % 7)::INTEGER + 1] AS stage,
CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderpriority < '3' THEN 'h1' ELSE 'h2' END AS config_hash, o_orderkey AS seq FROM orders),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY talk_id, stage ORDER BY seq DESC) AS r FROM runs) WHERE r = 1)"""


def _runs(spark, d) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, lineage.STAGES)), (F.col("o_orderkey") % 7).cast("int") + 1)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("talk_id"), stage.alias("stage"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.when(F.col("o_orderpriority") < "3", "h1").otherwise("h2").alias("config_hash"), F.col("o_orderkey").alias("seq"))


@query(_RUNS + """, w AS (SELECT c_custkey AS talk_id, unnest(['fetch', 'slides', 'transcript', 'align', 'synthesize', 'verify', 'render']) AS stage FROM customer)
SELECT w.talk_id, w.stage, NOT coalesce(l.status = 'done' AND l.config_hash = 'h1', FALSE) AS run FROM w LEFT JOIN latest l USING (talk_id, stage)""")
def q48_stage_should_run(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("talk_id"), F.explode(F.array(*map(F.lit, lineage.STAGES))).alias("stage"), F.lit("h1").alias("config_hash"))
    return lineage.should_run(wanted, _runs(spark, d)).select("talk_id", "stage", "run")


@query(_RUNS + """, o AS (SELECT *, list_position(['fetch', 'slides', 'transcript', 'align', 'synthesize', 'verify', 'render'], stage) AS k FROM latest)
SELECT talk_id, stage, CASE WHEN status = 'done' AND talk_id % 3 = 0 AND k > 3 THEN 'stale' ELSE status END AS status FROM o""")
def q49_stale_propagation(spark, d):
    changed = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("talk_id"), F.lit("transcript").alias("stage"))
    return lineage.invalidate(_runs(spark, d), changed)


@query("""SELECT p_partkey, substr(sha256('{"brand": "' || p_brand || '", "size": ' || p_size || ', "type": "' || p_type || '"}'), 1, 12) AS config_hash FROM part""")
def q50_config_hash(spark, d):
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return table(spark, d, "part").select("p_partkey", sc.params_hash({"type": quoted("p_type"), "brand": quoted("p_brand"), "size": F.col("p_size").cast("string")}).alias("config_hash"))


# Labels, links, small scalars.


@query("""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms FROM (SELECT event_id, floor(value * 100000 / 1000)::BIGINT AS s FROM events)""")
def q51_hms_spans(spark, d):
    return table(spark, d, "events").select("event_id", sc.hms(F.col("value") * 100000).alias("hms"))


@query(_EVENT_SPANS + """, b AS (SELECT user_id, min(start_ms) AS o FROM fused GROUP BY user_id), x AS (SELECT user_id, (start_ms - o) // 1000 AS a, (end_ms - o) // 1000 AS z, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM fused JOIN b USING (user_id))
SELECT user_id, string_agg(printf('%02d:%02d:%02d–%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60, z // 3600, z % 3600 // 60, z % 60), ', ' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN n > 3 THEN ' +' || (n - 3) ELSE '' END AS label FROM x GROUP BY user_id, n""")  # fmt: skip
def q52_span_label(spark, d):
    f = intervals.fuse(_event_spans(spark, d), ("user_id",))
    spans = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms")))
    rows = f.groupBy("user_id").agg(spans.alias("s"))
    zero = F.col("s")[0]["start_ms"]
    moved = F.transform("s", lambda x: F.struct((x["start_ms"] - zero).alias("start_ms"), (x["end_ms"] - zero).alias("end_ms")))
    return rows.select("user_id", sc.spans_label(moved).alias("label"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'https://youtu.be/abc?t=' || (turn * 777 * 1000 + 999) // 1000 END AS url, CASE WHEN length(text) <= 90 THEN text ELSE rtrim(text[1:87]) || '…' END AS label FROM conversations""")
def q53_chip(spark, d):
    t = F.when(F.col("turn") % 3 != 0, F.col("turn") * 777 * 1000 + 999)
    return table(spark, d, "conversations").select("conv_id", "turn", sc.chip_url(F.lit("abc"), F.col("text"), t).alias("url"), sc.chip_text(F.col("text")).alias("label"))


@query(r"""SELECT page_id, nullif(regexp_extract(u, '(?:v=|youtu\.be/|/shorts/|/live/|/embed/)([A-Za-z0-9_-]{11})', 1), '') AS video_id FROM (
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) || '?t=4' WHEN 2 THEN 'https://x.com/watch?a=1&v=' || substr(md5(url), 1, 12) ELSE 'https://x.com/shorts/' || substr(md5(url), 1, 10) END AS u FROM pages)""")
def q54_video_id(spark, d):
    h = F.md5("url")
    u = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 11), F.lit("?t=4"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://x.com/watch?a=1&v="), F.substring(h, 1, 12))).otherwise(F.concat(F.lit("https://x.com/shorts/"), F.substring(h, 1, 10)))
    return table(spark, d, "pages").select("page_id", sc.video_id(u).alias("video_id"))


@query(r"""SELECT p_partkey, CASE WHEN s = '' THEN 'video' ELSE s END AS slug FROM (SELECT p_partkey, rtrim(substr(lower(trim(regexp_replace(p_name || ' — ' || p_type || ' ' || p_brand || ' ' || p_type || ' ' || p_name, '[^A-Za-z0-9]+', '-', 'g'), '-')), 1, 48), '-') AS s FROM part)""")
def q55_slug(spark, d):
    name = F.concat_ws(" ", "p_name", F.lit("—"), "p_type", "p_brand", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", sc.slug(name).alias("slug"))


@query("""WITH t AS (SELECT doc_id, lang, [CASE WHEN doc_id % 5 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN 'en-GB' END, CASE WHEN doc_id % 7 = 0 THEN 'en-AU' END] AS m0, [CASE WHEN doc_id % 2 = 0 THEN 'en' END, CASE WHEN doc_id % 11 < 5 THEN lang || '-orig' END] AS a0 FROM documents),
u AS (SELECT doc_id, lang, list_filter(m0, lambda x: x IS NOT NULL) AS m, list_filter(a0, lambda x: x IS NOT NULL) AS a FROM t),
p AS (SELECT doc_id, coalesce(CASE WHEN list_contains(m, 'en') THEN 'en' END, list_min(list_filter(m, lambda x: starts_with(x, 'en-'))), CASE WHEN list_contains(m, lang) THEN lang END, list_min(list_filter(m, lambda x: starts_with(x, lang || '-')))) AS hand,
      coalesce(CASE WHEN list_contains(a, 'en') THEN 'en' END, list_min(list_filter(a, lambda x: starts_with(x, 'en-'))), CASE WHEN list_contains(a, lang) THEN lang END, list_min(list_filter(a, lambda x: starts_with(x, lang || '-'))), list_min(list_filter(a, lambda x: ends_with(x, '-orig')))) AS machine FROM u)
SELECT doc_id, coalesce(hand, machine) AS track, CASE WHEN hand IS NOT NULL THEN 'manual' WHEN machine IS NOT NULL THEN 'auto' ELSE 'none' END AS kind FROM p""")  # fmt: skip
def q56_caption_pick(spark, d):
    i, lang = F.col("doc_id"), F.col("lang")
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    manual = some(F.when(i % 5 == 0, lang), F.when(i % 3 == 0, F.lit("en-GB")), F.when(i % 7 == 0, F.lit("en-AU")))
    auto = some(F.when(i % 2 == 0, F.lit("en")), F.when(i % 11 < 5, F.concat(lang, F.lit("-orig"))))
    return table(spark, d, "documents").select("doc_id", captions.caption_choice(manual, auto, lang).alias("c")).select("doc_id", "c.track", "c.kind")


@query("""WITH e AS (SELECT doc_id % 50 AS talk_id, CASE WHEN source IN ('src0', 'src1') THEN 'vision' WHEN source IN ('src2', 'src3') THEN 'none' ELSE 'tesseract' END AS engine FROM documents),
c AS (SELECT talk_id, engine, count(*) AS n FROM e GROUP BY ALL) SELECT talk_id, string_agg(engine || '=' || n, ',' ORDER BY engine) AS engines, bool_or(engine = 'vision') AS vision FROM c GROUP BY talk_id""")
def q57_engine_counts(spark, d):
    engine = F.when(F.col("source").isin("src0", "src1"), "vision").when(F.col("source").isin("src2", "src3"), "none").otherwise("tesseract")
    e = slides.engines_used(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("talk_id"), engine.alias("engine")))
    said = F.array_join(F.transform(F.map_entries("engines"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return e.select("talk_id", said.alias("engines"), "vision")


@query("""SELECT o_custkey, round(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,6)) END), 4)::DOUBLE AS cost FROM orders GROUP BY o_custkey""")
def q58_cost_sum(spark, d):
    calls = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("cost"))
    return digest.cost(calls, "o_custkey")


@query("SELECT d.doc_id || '.png' AS file FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def q59_anti_files(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file")
    return slides.stale_files(table(spark, d, "documents").select(name), table(spark, d, "labels").where("quality = 1").select(name))


@query("SELECT trim(url) AS url FROM (SELECT CASE page_id % 3 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN '# ' || url ELSE '   ' END AS url FROM pages) WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')")
def q60_batch_file_filter(spark, d):
    v = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("# "), "url")).otherwise(F.lit("   "))
    return captions.link_list(table(spark, d, "pages").select(v.alias("value")))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS json FROM events""")
def q61_json_extract(spark, d):
    p = F.col("props")
    said = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nbye"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("so "), p, F.lit(" it is"))).otherwise(F.concat(F.lit("no { json "), F.col("event_type")))
    return table(spark, d, "events").select("event_id", sc.loose_json(said).alias("json"))


@query("""WITH b AS (SELECT conv_id, turn, (turn * 37 % 101) / 4.0 AS x, ((turn // 3) * 0.25)::DOUBLE AS y, role FROM conversations),
l AS (SELECT conv_id, y, string_agg(role, ' ' ORDER BY x, role) AS line FROM b GROUP BY ALL) SELECT conv_id, string_agg(line, chr(10) ORDER BY y DESC) AS text FROM l GROUP BY conv_id""")
def q62_reading_order(spark, d):
    b = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 37 % 101 / 4.0).alias("x"), (F.floor(F.col("turn") / 3) * 0.25).alias("y"), F.col("role").alias("text"))
    return captions.reading_order(b, ("conv_id",))


@query("""WITH t AS (SELECT conv_id, min(CASE WHEN conv_id % 3 <> 0 THEN CASE role WHEN 'user' THEN 'en-US' ELSE 'de' END || '.json3' END) AS track FROM conversations GROUP BY conv_id)
SELECT conv_id AS talk_id, CASE WHEN track IS NULL THEN 'asr' ELSE 'captions' END AS source, track, string_split(track, '-')[1] AS language FROM t""")
def q63_source_choice(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), F.concat(F.when(F.col("role") == "user", "en-US").otherwise("de"), F.lit(".json3")).alias("track"))
    return cues.choose_source(t.select("talk_id").distinct(), t.where("talk_id % 3 <> 0"))


@query("""SELECT conv_id AS talk_id, turn AS ord, CASE WHEN turn % 2 = 0 THEN 'https://youtu.be/vid?t=' || turn * 60 END AS url, turn % 5 = 4 AS from_slide, CASE WHEN turn % 2 = 0 THEN printf('%02d:%02d:00', turn // 60, turn % 60) END AS hms FROM conversations""")
def q64_report_chips(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.col("turn") * 60_000)
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("talk_id"), F.lit("points").alias("path"), F.col("turn").alias("ord"), F.lit("vid").alias("video_id"), F.col("text").alias("quote"), t.alias("t"), F.when(F.col("turn") % 5 == 4, "slide").otherwise("speech").alias("source"))
    return report.chips(p).select("talk_id", "ord", "url", "from_slide", "hms")


@query(with_parts(SEGMENTS, TALKS, WORD_WINDOWS, r"""
, said AS (SELECT w.talk_id, w.w_ord, string_agg(text, ' ' ORDER BY seg_idx) AS t FROM word_windows w JOIN segs s ON s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms GROUP BY ALL)
SELECT talk_id, printf('w%02d', w_ord) AS window_id, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')[1:6], ' ') AS quote FROM said"""))  # fmt: skip
def q65_extracted_points(spark, d):
    return digest.extract_points(windows.pack_lines(adapters.segments(spark, d), q05_word_windows(spark, d)))


@query(with_parts(SEGMENTS, TALKS, WORD_WINDOWS, """
SELECT w.talk_id, count(*) AS quotes_total, count(*) AS quotes_grounded FROM word_windows w WHERE EXISTS (SELECT 1 FROM segs s WHERE s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms) GROUP BY w.talk_id"""))  # fmt: skip
def q66_grounded_extracts(spark, d):
    """End to end: windows, lines, extractive points, anchored in their talks. All of them are grounded."""
    segs = adapters.segments(spark, d)
    points = materialize(q65_extracted_points(spark, d).withColumn("quote_id", F.xxhash64("talk_id", "window_id")), "points")
    found = anchor.anchor(points.select("quote_id", "talk_id", "quote"), segs, adapters.slides(spark, d))
    return digest.quote_totals(found.join(points.select("quote_id", "quote"), "quote_id"), "talk_id")


@query("""SELECT p_partkey, CASE WHEN p_size = 0 OR p_size % 5 = 0 THEN -1 ELSE p_size END AS size, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE p_type END AS type FROM part""")
def q67_falsy_defaults(spark, d):
    size = sc.missing(F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(F.col("p_size")), F.lit(-1))
    kind = sc.missing(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_type")), F.lit("none"))
    return table(spark, d, "part").select("p_partkey", size.alias("size"), kind.alias("type"))


@query("""SELECT s.talk_id, count(*) AS n FROM (SELECT l_orderkey AS talk_id, l_linenumber * 1000 AS a, l_linenumber * 1000 + l_quantity::BIGINT * 100 AS z FROM lineitem) s
JOIN (SELECT l_orderkey AS talk_id, l_partkey % 5000 AS a, l_partkey % 5000 + 1500 AS z FROM lineitem) w ON w.talk_id = s.talk_id AND s.a < w.z AND s.z > w.a GROUP BY s.talk_id""")
def q68_bucketed_overlap(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("talk_id"), (F.col("l_linenumber") * 1000).cast("long").alias("a_start"), (F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long") * 100).alias("a_end"))
    b = li.select(F.col("l_orderkey").alias("talk_id"), (F.col("l_partkey") % 5000).alias("b_start"), (F.col("l_partkey") % 5000 + 1500).alias("b_end"))
    return intervals.bucketed_overlap_join(a, b, 2000, ("talk_id",)).groupBy("talk_id").agg(F.count("*").alias("n"))


@query("""SELECT talk_id, sum(chars) <= 60000 AS embed FROM (SELECT doc_id % 50 AS talk_id, strlen(text) AS chars FROM documents) GROUP BY talk_id""")
def q69_embedding_plan(spark, d):
    images = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("talk_id"), F.encode("text", "UTF-8").alias("bytes"))
    return report.embedding_plan(images, 60_000)


@query(_ITEMS + " SELECT doc_id::VARCHAR AS url FROM items WHERE error_class IS DISTINCT FROM 'FAILED_FINAL'")
def q70_batch_work(spark, d):
    items = _items(spark, d).withColumn("url", F.col("doc_id").cast("string"))
    return lineage.batch_work(items.select("url"), items)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'j,z' ELSE '' END AS unknown, CASE WHEN event_id % 7 = 0 THEN 'k,v' ELSE 'v' END AS missing FROM events""")
def q71_closed_documents(spark, d):
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 7 == 0, F.lit("{}")).otherwise(F.col("props"))
    extra = F.when(F.col("event_id") % 5 == 0, F.lit('{"z": 1, "j": null, "k": 2}')).otherwise(F.lit('{"k": 1}'))
    return e.select("event_id", F.array_join(schemas.unknown_keys(extra, ("k",)), ",").alias("unknown"), F.array_join(schemas.missing_keys(doc, ("k", "v")), ",").alias("missing"))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, """
SELECT w.talk_id, printf('w%02d', w.w_ord) AS window_id, title, count(*) FILTER (WHERE role = 'primary') AS n_primary, count(*) FILTER (WHERE role = 'context') AS n_context,
       coalesce(min(slide_id) FILTER (WHERE role = 'primary'), -1) AS first_slide FROM chapter_windows w LEFT JOIN assigned a ON a.talk_id = w.talk_id AND a.w_ord = w.w_ord GROUP BY ALL"""))
def q72_synth_inputs(spark, d):
    w, s = materialize(_chapter_windows(spark, d), "windows"), materialize(adapters.slides(spark, d), "slides")
    got = digest.synth_inputs(w, windows.pack_lines(adapters.segments(spark, d), w), intervals.assign_slides(s, w), s)
    return got.select("talk_id", "window_id", "title", F.size("primary").cast("long").alias("n_primary"), F.size("context").cast("long").alias("n_context"), F.coalesce(F.get("primary", F.lit(0))["slide_id"], F.lit(-1)).alias("first_slide"))


# End to end: answers, entries, overview, stamps, totals, reports.

_WINDOW_SAID = r"""
, said AS (SELECT w.talk_id, w.w_ord, string_agg(text, ' ' ORDER BY seg_idx) AS t FROM chapter_windows w JOIN segs s ON s.talk_id = w.talk_id AND s.start_ms < hi_ms AND s.end_ms > lo_ms GROUP BY ALL),
quoted AS (SELECT talk_id, w_ord, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')[1:6], ' ') AS quote FROM said)"""


def _answers(spark, d, segs: DataFrame, slide_rows: DataFrame) -> DataFrame:
    talks = adapters.talks(segs)
    w = materialize(windows.build_windows(talks, segs, adapters.chapters(segs, d), 10**9), "windows")
    return brief.answers(w, windows.pack_lines(segs, w), intervals.assign_slides(slide_rows, w), slide_rows)


def _brief(spark, d, tag: str):
    """(segments, slides, answers), each written once."""
    segs, shown = materialize(adapters.segments(spark, d), "segments"), materialize(adapters.slides(spark, d), "slides")
    return segs, shown, materialize(_answers(spark, d, segs, shown), f"answers-{tag}")


def _stamped(spark, d, tag: str):
    segs, shown, said = _brief(spark, d, tag)
    entries = materialize(brief.slide_entries(said, shown), "entries")
    return segs, entries, brief.stamped(brief.streams(brief.overview(said), entries, brief.window_points(said)), segs, shown)


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, _WINDOW_SAID, """
SELECT h.talk_id, h.slide_id, printf('w%02d', h.w_ord) AS window_id, coalesce(nullif(trim(string_split(trim(ocr_text), chr(10))[1]), ''), 'Slide ' || idx) AS heading, quote
FROM homes h JOIN slides s USING (talk_id, slide_id) LEFT JOIN quoted q ON q.talk_id = h.talk_id AND q.w_ord = h.w_ord"""))  # fmt: skip
def q73_slide_entries(spark, d):
    _, shown, said = _brief(spark, d, "entries")
    return brief.slide_entries(said, shown).select("talk_id", "slide_id", "window_id", "heading", "quote")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, _WINDOW_SAID, """
SELECT w.talk_id, w.w_ord, printf('w%02d', w.w_ord) AS window_id, quote FROM chapter_windows w LEFT JOIN quoted q ON q.talk_id = w.talk_id AND q.w_ord = w.w_ord
WHERE NOT EXISTS (SELECT 1 FROM homes h WHERE h.talk_id = w.talk_id AND h.w_ord = w.w_ord)"""))  # fmt: skip
def q74_window_points(spark, d):
    return brief.window_points(_brief(spark, d, "points")[2])


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, """
SELECT talk_id, string_agg(rtrim(printf('w%02d [%02d:%02d:%02d] ', w_ord, s // 3600, s % 3600 // 60, s % 60) || title), chr(10) ORDER BY w_ord) AS outline
FROM (SELECT *, (lo_ms // 1000)::BIGINT AS s FROM chapter_windows) GROUP BY talk_id"""))  # fmt: skip
def q75_outline(spark, d):
    return brief.outline(_chapter_windows(spark, d))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, _WINDOW_SAID, """
, all_windows AS (SELECT w.talk_id, w.w_ord, quote FROM chapter_windows w LEFT JOIN quoted q ON q.talk_id = w.talk_id AND q.w_ord = w.w_ord),
said6 AS (SELECT talk_id, 'chapters' AS path, quote FROM all_windows UNION ALL
SELECT talk_id, 'takeaways', arg_min(quote, w_ord) FROM all_windows WHERE coalesce(quote, '') <> '' GROUP BY talk_id UNION ALL
SELECT h.talk_id, 'slides', quote FROM homes h LEFT JOIN all_windows a ON a.talk_id = h.talk_id AND a.w_ord = h.w_ord UNION ALL
SELECT talk_id, 'windows', quote FROM all_windows a WHERE NOT EXISTS (SELECT 1 FROM homes h WHERE h.talk_id = a.talk_id AND h.w_ord = a.w_ord))
SELECT talk_id, path, count(*) AS points, count(*) FILTER (WHERE coalesce(quote, '') <> '') AS quotes FROM said6 GROUP BY ALL"""))  # fmt: skip
def q76_quote_streams(spark, d):
    _, shown, said = _brief(spark, d, "streams")
    six = brief.streams(brief.overview(said), brief.slide_entries(said, shown), brief.window_points(said))
    return six.groupBy("talk_id", "path").agg(F.count("*").alias("points"), F.count_if(F.coalesce("quote", F.lit("")) != "").alias("quotes"))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, TALK_TOKENS, _WINDOW_SAID, r"""
, ct AS (SELECT talk_id, w_ord, quote, len(w) AS m, unnest(range(0, len(w))) AS off, unnest(w) AS tok FROM (SELECT *, regexp_extract_all(lower(quote), '[\p{L}\p{N}]+') AS w FROM quoted)),
h AS (SELECT talk_id, w_ord, m, pos - off AS pos FROM ct JOIN talk_tokens USING (talk_id, tok) GROUP BY talk_id, w_ord, m, pos - off HAVING count(*) = m),
f AS (SELECT talk_id, w_ord, min(pos) AS pos FROM h GROUP BY talk_id, w_ord, m HAVING m >= 4 OR count(*) <= 3)
SELECT w.talk_id, w.w_ord - 1 AS ord, quote, t AS start_ms FROM chapter_windows w LEFT JOIN quoted q ON q.talk_id = w.talk_id AND q.w_ord = w.w_ord
LEFT JOIN f ON f.talk_id = w.talk_id AND f.w_ord = w.w_ord LEFT JOIN talk_tokens k ON k.talk_id = f.talk_id AND k.pos = f.pos"""))  # fmt: skip
def q77_chapter_stamps(spark, d):
    return brief.chapter_starts(_stamped(spark, d, "stamps")[2])


@query()
def q78_verification(spark, d):
    """A whole brief of every talk, verified: quotes, grounded quotes, hard-token recall, and whether it is weak."""
    segs, entries, marked = _stamped(spark, d, "verified")
    out = brief.verified(materialize(marked, "stamped"), entries, segs)
    return out.select("talk_id", "quotes_total", "quotes_grounded", "token_recall", F.array_join("missing", ",").alias("missing"), "weak")


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, "SELECT talk_id, label, count(*) AS calls, sum(cost) AS cost FROM (SELECT talk_id, printf('map_w%02d', w_ord) AS label, 0.0::DOUBLE AS cost FROM chapter_windows UNION ALL SELECT talk_id, 'reduce', 0.0 FROM talks) GROUP BY ALL"))
def q79_call_audit(spark, d):
    _, shown, said = _brief(spark, d, "calls")
    return brief.calls(said, shown).groupBy("talk_id", "label").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


@query(_RUNS + """, fresh AS (SELECT o_custkey AS talk_id, 'verify' AS stage, max(o_comment) AS said FROM (SELECT o_custkey, 'p' || o_orderpriority || o_orderstatus AS o_comment FROM orders) GROUP BY ALL),
grown AS (SELECT talk_id, stage, status, NULL AS error FROM latest l WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.talk_id = l.talk_id AND f.stage = l.stage) UNION ALL SELECT talk_id, stage, 'failed', right(said, 5) FROM fresh)
SELECT talk_id, stage, status, error FROM grown""")
def q80_stage_log(spark, d):
    """A stage has run for every talk and failed: the log grows by a row for each, with the end of its error."""
    said = F.concat(F.lit("p"), "o_orderpriority", "o_orderstatus")
    fresh = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("talk_id")).agg(F.max(said).alias("error"))
    fresh = fresh.select("talk_id", F.lit("verify").alias("stage"), F.lit("failed").alias("status"), F.lit("h1").alias("config_hash"), "error")
    log = lineage.marked(_runs(spark, d).withColumn("error", F.lit(None).cast("string")), fresh, 5)
    return lineage.latest(log, ("talk_id", "stage")).select("talk_id", "stage", "status", "error")


@query("""SELECT doc_id, CASE CASE WHEN lang = 'en' THEN 'en' ELSE 'he' END WHEN 'en' THEN 'Key takeaways' ELSE 'תובנות מרכזיות' END AS title,
CASE WHEN lang = 'en' THEN 'hard-token recall ' || n_chars ELSE 'כיסוי אסימונים קשיחים ' || n_chars END AS recall, 'Glossary' AS other FROM documents""")
def q81_labels(spark, d):
    lang = F.when(F.col("lang") == "en", "en").otherwise("he")
    said = report.filled(report.label(lang, "token_recall"), recall=F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", report.label(lang, "key_takeaways").alias("title"), said.alias("recall"), report.label(F.lit("xx"), "glossary").alias("other"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * 2) || '%' AS share FROM lineitem")
def q82_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.percent(F.col("l_quantity") / 50).alias("share"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_diff('day', ts::DATE, DATE '2024-03-01') > 60 END AS is_old FROM events")
def q83_version_age(spark, d):
    version = F.when(F.col("event_id") % 5 != 0, F.concat(F.date_format("ts", "yyyy.MM.dd"), F.lit(".1"))).otherwise("v7")
    return table(spark, d, "events").select("event_id", sc.is_old(version, F.lit("2024-03-01").cast("date")).alias("is_old"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN lang WHEN doc_id % 2 = 0 THEN source ELSE '' END AS text,
CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'vision' WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'tesseract' ELSE 'vision' END AS engine FROM documents""")
def q84_ocr_ladder(spark, d):
    i = F.col("doc_id")
    there = i % 3 != 0
    vision = F.when(there, F.when(i % 4 == 0, F.col("lang")).otherwise(""))
    other = F.when(i % 2 == 0, F.col("source")).otherwise("")
    return table(spark, d, "documents").select("doc_id", captions.recognised(vision, other, there).alias("r")).select("doc_id", "r.text", "r.engine")


@query("""SELECT page_id::VARCHAR AS id, url, CASE WHEN page_id % 3 = 0 THEN 'untitled' ELSE 'page ' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN 'owner' ELSE 'up' END AS channel,
CASE WHEN page_id % 4 = 0 THEN 0.0 ELSE page_id * 1.5 END::DOUBLE AS duration_s, length(substr(html, 1, 2000)) AS n_description, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'a,b' END AS manual FROM pages""")
def q85_metadata(spark, d):
    i = F.col("page_id")
    info = table(spark, d, "pages").select(
        i.cast("string").alias("id"), F.lit(None).cast("string").alias("webpage_url"), "url", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("page "), i.cast("string"))).alias("title"),
        F.when(i % 2 == 0, "owner").otherwise("").alias("channel"), F.lit("up").alias("uploader"), F.when(i % 4 != 0, i * 1.5).cast("double").alias("duration"), F.lit(None).cast("string").alias("upload_date"),
        F.lit("en").alias("language"), F.col("html").alias("description"), F.lit(None).cast("array<struct<title:string,start_time:double,end_time:double>>").alias("chapters"),
        F.when(i % 5 != 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("y"))).alias("subtitles"), F.lit(None).cast("map<string,string>").alias("automatic_captions"),
    )
    kept = captions.distill(info)
    return kept.select("id", "url", "title", "channel", "duration_s", F.length("description").cast("long").alias("n_description"), F.array_join("manual", ",").alias("manual"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'fetch,slides,transcript,align,synthesize,verify,render' WHEN 1 THEN 'fetch,verify,render' ELSE 'fetch,synthesize' END AS stages, c_custkey % 3 <> 1 AS asks FROM customer""")
def q86_planned_stages(spark, d):
    i = F.col("c_custkey") % 3
    only = F.when(i == 1, F.array(F.lit("render"), F.lit("verify"))).when(i == 2, F.array(F.lit("synthesize")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(lineage.planned(only), ",").alias("stages"), lineage.asks_model(only).alias("asks"))


@query(r"""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def q87_distinct_in_order(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(fast_tokens(F.col("text"))), " ").alias("words"))


@query("SELECT 'c' || o_custkey AS id, min('/runs/c' || o_custkey || '__' || o_orderkey || '-talk') AS path FROM orders GROUP BY o_custkey")
def q88_existing_run(spark, d):
    path = F.concat(F.lit("/runs/c"), F.col("o_custkey").cast("string"), F.lit("__"), F.col("o_orderkey").cast("string"), F.lit("-talk"))
    odd = spark.createDataFrame([("/runs/notes",)], "path string")
    return lineage.existing_run(table(spark, d, "orders").select(path.alias("path")).unionByName(odd))


@query(with_parts(SEGMENTS, TALKS, CHAPTERS, CHAPTER_WINDOWS, SLIDES, SLIDE_SUMS, _PRIMARY, """
SELECT h.talk_id, h.slide_id, coalesce(nullif(trim(string_split(trim(ocr_text), chr(10))[1]), ''), 'Slide ' || idx) AS heading,
printf('%02d:%02d:%02d', first_seen_ms // 1000 // 3600, first_seen_ms // 1000 % 3600 // 60, first_seen_ms // 1000 % 60) AS hms FROM homes h JOIN slides USING (talk_id, slide_id) WHERE h.slide_id % 2 = 0"""))  # fmt: skip
def q89_report_cards(spark, d):
    """Cards of those slides that the digest has: here, every second one."""
    _, shown, said = _brief(spark, d, "cards")
    entries = brief.slide_entries(said, shown)
    return report.cards(shown, entries, shown.where("slide_id % 2 = 0")).select("talk_id", "slide_id", "heading", "hms")


__all__ = ["FLAGSHIP", "Window", "oracle_sql", "queries"]
