"""What the documents of a talk must look like: Spark types, closed sets of keys, allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start_ms:bigint,end_ms:bigint>"
POINT = "struct<text:string,quote:string>"
#: Spark types of the documents that go from stage to stage.
TYPES = {
    "transcript": f"talk_id bigint, language string, source string, kind string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, ok boolean, spoken_fraction double, gaps array<{SPAN}>",
    "slides": f"talk_id bigint, slide_id string, idx int, first_seen_ms bigint, spans array<{SPAN}>, on_screen_ms bigint, times_returned int, ocr_text string, ocr_engine string, builds int, source string",
    "alignment": "talk_id bigint, window_id string, lo_ms bigint, hi_ms bigint, title string, word_count bigint, primary_slide_ids array<string>, context_slide_ids array<string>",
    "window_result": f"window_id string, slides array<struct<slide_id:string,heading:string,what_it_shows:string,speaker_points:array<{POINT}>,significance:string,not_said_aloud:string>>, window_points array<{POINT}>, window_summary string",
    "overview": f"tldr string, narrative array<string>, key_takeaways array<{POINT}>, glossary array<struct<term:string,definition:string,quote:string>>, chapters array<struct<title:string,one_liner:string,quote:string>>, numbers_and_names array<struct<item:string,quote:string,source:string>>",
}
#: Columns with a closed set of values.
ALLOWED = {
    "transcript": {"source": ("captions", "asr", "none"), "kind": ("manual", "auto", "asr", "none")},
    "slides": {"ocr_engine": ("vision", "tesseract", "none"), "source": ("hash", "floor")},
}


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object that a closed document doesn't have, sorted; null if the text is no object."""
    keys = F.json_object_keys(json)
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed))))


def missing_keys(json: Column, required: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(json)))


def violations(df: DataFrame, name: str) -> DataFrame:
    """df's rows that break a rule of the document, with ``broken``: the columns whose value isn't allowed."""
    rules = [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.lit(c)) for c, values in ALLOWED.get(name, {}).items()]
    broken = F.filter(F.array(*rules, F.lit(None).cast("string")), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def as_json(row: Column) -> Column:
    """A struct as JSON with its nulls, which Spark would leave out by itself."""
    return F.to_json(row, {"ignoreNullFields": "false"})
