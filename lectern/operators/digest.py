"""Assembles digests: routing, placeholders, quotes, an extractive synthesizer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.scalars import first_line, route

POINT = "struct<text:string,quote:string>"


def routed(slides: DataFrame, min_chars: int = 200) -> DataFrame:
    return slides.withColumn("route", route(F.col("ocr_text"), F.length("ocr_text"), min_chars))


def image_budget(primaries: DataFrame, most: int = 24) -> DataFrame:
    """Of a window's slides that go as images the ones shown longest stay images, at most so many; the others go as text."""
    w = Window.partitionBy("talk_id", "window_id", "route").orderBy(F.desc("on_screen_ms"), "first_seen_ms", "slide_id")
    over = (F.col("route") == "image") & (F.row_number().over(w) > most)
    return primaries.withColumn("over", over).withColumn("route", F.when(F.col("over"), F.lit("text")).otherwise(F.col("route"))).drop("over")


def with_entries(slides: DataFrame, entries: DataFrame) -> DataFrame:
    """Each slide with its synthesized entry (slide_id, w_ord, heading, what_it_shows, significance), the last window's
    if several have one, or a placeholder: the first line of its text, or "Slide n". Entries of no slide are dropped."""
    fields = ("heading", "what_it_shows", "significance")
    one = entries.groupBy("talk_id", "slide_id").agg(F.max_by(F.struct(*fields), "w_ord").alias("e"))
    j = slides.join(one, ["talk_id", "slide_id"], "left")
    heading = F.coalesce("e.heading", first_line(F.col("ocr_text"), F.concat(F.lit("Slide "), F.col("idx").cast("string"))))
    return j.select("talk_id", "slide_id", heading.alias("heading"), *(F.coalesce(f"e.{f}", F.lit("")).alias(f) for f in fields[1:]), F.col("e").isNull().alias("placeholder"))


def quote_union(**parts: DataFrame) -> DataFrame:
    """(talk_id, path, ord, quote) of the parts, in their order."""
    out = None
    for path, df in parts.items():
        part = df.select("talk_id", F.lit(path).alias("path"), "ord", "quote")
        out = part if out is None else out.unionByName(part)
    return out


def quote_totals(anchored: DataFrame, *keys: str) -> DataFrame:
    """(keys, quotes_total, quotes_grounded): empty quotes count in neither."""
    said = F.coalesce("quote", F.lit("")) != ""
    return anchored.groupBy(*keys).agg(F.count_if(said).alias("quotes_total"), F.count_if(said & F.coalesce("grounded", F.lit(False))).alias("quotes_grounded"))


def cost(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, cost): summed in decimals to four places, null where no call tells one."""
    return calls.groupBy(*keys).agg(F.round(F.sum(F.col("cost").cast("decimal(18,6)")), 4).cast("double").alias("cost"))


def synth_inputs(windows: DataFrame, lines: DataFrame, assigned: DataFrame, slides: DataFrame) -> DataFrame:
    """(talk_id, window_id, title, lines, primary, context): what a synthesizer is asked about each window, lines and slides in order of time."""
    said = lines.groupBy("talk_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("line", "start_ms", "text"))).alias("lines"))
    shown = assigned.join(slides.select("talk_id", "slide_id", "first_seen_ms", "ocr_text"), ["talk_id", "slide_id"])
    one = F.struct("first_seen_ms", "slide_id", "ocr_text")
    per = shown.groupBy("talk_id", "window_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, one))).alias(r) for r in ("primary", "context")))
    both = windows.select("talk_id", "window_id", "title").join(said, ["talk_id", "window_id"], "left").join(per, ["talk_id", "window_id"], "left")
    none = F.array()
    return both.select("talk_id", "window_id", "title", *(F.coalesce(c, none.cast(dict(both.dtypes)[c])).alias(c) for c in ("lines", "primary", "context")))


def verification(anchored: DataFrame, recalled: DataFrame, *keys: str) -> DataFrame:
    """(keys, quotes_total, quotes_grounded, token_recall, missing, weak): weak where under 80 % of the quotes are grounded."""
    out = quote_totals(anchored, *keys).join(recalled.withColumnRenamed("recall", "token_recall"), list(keys), "left")
    return out.withColumn("weak", (F.col("quotes_total") > 0) & (F.col("quotes_grounded") < 0.8 * F.col("quotes_total")))


def extract_points(lines: DataFrame) -> DataFrame:
    """The default synthesizer, extractive: a window's point quotes the first six words of its first line."""
    first = lines.groupBy("talk_id", "window_id").agg(F.min_by("text", "line").alias("text"))
    return first.select("talk_id", "window_id", F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 6), " ").alias("quote"))


SYNTHESIZERS: dict[str, Callable[[dict], dict]] = {}


def synthesizer(name: str):
    """Registers a function from a request (a row as a dict) to an answer."""

    def put(f):
        SYNTHESIZERS[name] = f
        return f

    return put


class AccessError(Exception):
    """The model refuses this caller: trying again cannot help."""


class AnswerError(ValueError):
    """An answer that breaks the schema: the next attempt is told why."""


def synthesize(requests: DataFrame, name: str, schema: str, attempts: int = 3, required: tuple[str, ...] = (), wait_s: float = 0.0) -> DataFrame:
    """Calls a registered synthesizer for each row; what raises is tried again, and then gives a row with its error.

    An AccessError ends a row at once. After an AnswerError, or an answer without one of the ``required`` fields, the request
    of the next attempt has the reason in ``problem``; after other errors there is a pause of wait_s times the number
    of attempts so far.
    """
    if name not in SYNTHESIZERS:
        raise ValueError(f"no synthesizer {name!r}; there are {sorted(SYNTHESIZERS)}")
    f, arrow = SYNTHESIZERS[name], to_arrow_schema(T.StructType.fromDDL(schema))

    def asked(request: dict) -> dict:
        problem = None
        for k in range(1, attempts + 1):
            try:
                answer = f(request if problem is None else {**request, "problem": problem})
                missing = [x for x in required if answer.get(x) is None]
                if missing:
                    raise AnswerError(f"missing: {', '.join(missing)}")
                return {**answer, "error": None}
            except Exception as e:  # a row's failure must not fail the job; it is reported in its row
                if k == attempts or isinstance(e, AccessError):
                    return {"talk_id": request.get("talk_id"), "window_id": request.get("window_id"), "error": str(e)[-500:]}
                if isinstance(e, AnswerError):
                    problem = str(e)
                elif wait_s:
                    time.sleep(wait_s * k)
        raise AssertionError("no attempt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([asked(r) for r in batch.to_pylist()], arrow)

    return requests.mapInArrow(run, schema)
