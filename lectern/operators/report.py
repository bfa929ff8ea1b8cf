"""The rows that a report is rendered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import chip_text, chip_url, hms, spans_label

#: Labels by language.
LABELS = {
    "en": {
        "overview": "Overview",
        "tldr": "TL;DR",
        "key_takeaways": "Key takeaways",
        "glossary": "Glossary",
        "chapters": "Chapters",
        "numbers_and_names": "Numbers & names",
        "slides": "Slides",
        "on_screen": "on screen",
        "returned": "returned ×{n}",
        "not_said_aloud": "On the slide, not said aloud",
        "transcript": "Transcript for this section",
        "watch": "Watch",
        "unverified": "quote not found in transcript",
        "grounding": "{grounded}/{total} quotes verified against the transcript",
        "token_recall": "hard-token recall {recall}",
        "generated_by": "Generated by",
        "transcript_only": "No slides were detected in this video — this is a transcript-only brief.",
        "significance": "Why it matters",
        "window_notes": "Section notes",
        "theme": "Theme",
        "source": "slide",
    },
    "he": {
        "overview": "מבט-על",
        "tldr": "תקציר",
        "key_takeaways": "תובנות מרכזיות",
        "glossary": "מילון מונחים",
        "chapters": "פרקים",
        "numbers_and_names": "מספרים ושמות",
        "slides": "שקפים",
        "on_screen": "על המסך",
        "returned": "חזר ×{n}",
        "not_said_aloud": "כתוב על השקף, לא נאמר בקול",
        "transcript": "התמליל של הקטע הזה",
        "watch": "צפייה",
        "unverified": "הציטוט לא אותר בתמליל",
        "grounding": "{grounded}/{total} ציטוטים אומתו מול התמליל",
        "token_recall": "כיסוי אסימונים קשיחים {recall}",
        "generated_by": "נוצר על ידי",
        "transcript_only": "לא זוהו שקפים בסרטון — זהו תקציר מבוסס-תמליל בלבד.",
        "significance": "למה זה חשוב",
        "window_notes": "הערות הקטע",
        "theme": "ערכת נושא",
        "source": "שקף",
    },
}


def label(lang, name: str):
    """A label in a language, English where that is not known."""
    by_lang = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[name])))
    return F.coalesce(F.try_element_at(by_lang, lang), F.lit(LABELS["en"][name]))


def chips(points: DataFrame) -> DataFrame:
    """(talk_id, path, ord, url, label, from_slide, hms) of anchored quotes."""
    url = chip_url(F.col("video_id"), F.col("quote"), F.col("t"))
    return points.select("talk_id", "path", "ord", url.alias("url"), chip_text(F.col("quote")).alias("label"), (F.col("source") == "slide").alias("from_slide"), F.when(F.col("t").isNotNull(), hms(F.col("t"))).alias("hms"))


def cards(slides: DataFrame, entries: DataFrame, used: DataFrame) -> DataFrame:
    """A card for each slide that the digest has."""
    kept = slides.join(used.select("talk_id", "slide_id"), ["talk_id", "slide_id"], "left_semi").join(entries, ["talk_id", "slide_id"])
    return kept.select("talk_id", "slide_id", "heading", hms(F.col("first_seen_ms")).alias("hms"), spans_label(F.col("spans")).alias("spans_label"))


def embedding_plan(images: DataFrame, most_bytes: int = 25_000_000) -> DataFrame:
    """(talk_id, embed): do a talk's images fit into the report?"""
    return images.groupBy("talk_id").agg((F.sum(F.length("bytes")) <= most_bytes).alias("embed"))


def filled(pattern: Column, **values: Column) -> Column:
    """A label with each {name} replaced by its value."""
    for name, value in values.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), value.cast("string"))
    return pattern
