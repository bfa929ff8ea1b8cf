"""Common parts of the queries' SQL: the adapters' rules once more."""

from __future__ import annotations

#: Lines of conversations as segments.
SEGMENTS = r"""conv_lines AS (SELECT conv_id AS talk_id, turn, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS text FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations)),
conv_words AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM conv_lines),
conv_took AS (SELECT *, (CASE WHEN row_number() OVER (PARTITION BY talk_id, turn ORDER BY line) = 1 THEN (turn * 7 % 5) * 20000 ELSE 0 END) + 400 * words AS took FROM conv_words WHERE words > 0),
segs AS (SELECT talk_id, row_number() OVER w - 1 AS seg_idx, turn, (sum(took) OVER w - 400 * words)::BIGINT AS start_ms, (sum(took) OVER w)::BIGINT AS end_ms, words, text FROM conv_took WINDOW w AS (PARTITION BY talk_id ORDER BY turn, line))"""

TALKS = "talks AS (SELECT talk_id, max(end_ms) AS duration_ms FROM segs GROUP BY talk_id)"

CUES = (
    SEGMENTS
    + """, cues AS (SELECT talk_id, seg_idx * 2 AS ord, start_ms, end_ms, text FROM segs UNION ALL
SELECT talk_id, seg_idx * 2 + 1, start_ms + (end_ms - start_ms) // 2, end_ms + (end_ms - start_ms) // 2, text FROM segs WHERE seg_idx % 3 = 0)"""
)

CHAPTERS = """chapters AS (SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY s.turn) - 1 AS idx, role AS title, start_ms, end_ms FROM
(SELECT talk_id, turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM segs GROUP BY ALL) s JOIN conversations c ON c.conv_id = talk_id AND c.turn = s.turn)"""

#: All talks have two turns or more; the last chapter reaches to the talk's end.
CHAPTER_WINDOWS = "chapter_windows AS (SELECT talk_id, idx + 1 AS w_ord, start_ms AS lo_ms, end_ms AS hi_ms, title FROM chapters)"

WORD_WINDOWS = """walk AS (SELECT talk_id, -1::BIGINT AS seg_idx, 0::BIGINT AS lo, 0::BIGINT AS acc, NULL::BIGINT AS a, NULL::BIGINT AS z FROM talks UNION ALL
SELECT s.talk_id, s.seg_idx, CASE WHEN acc + words >= 120 THEN s.end_ms ELSE lo END, CASE WHEN acc + words >= 120 THEN 0 ELSE acc + words END, CASE WHEN acc + words >= 120 THEN lo END, CASE WHEN acc + words >= 120 THEN s.end_ms END
FROM walk w JOIN segs s ON s.talk_id = w.talk_id AND s.seg_idx = w.seg_idx + 1),
closed AS (SELECT talk_id, a, z FROM walk WHERE z IS NOT NULL UNION ALL
SELECT talk_id, lo, duration_ms FROM (SELECT talk_id, arg_max(lo, seg_idx) AS lo FROM walk GROUP BY talk_id) JOIN talks USING (talk_id) WHERE lo < duration_ms - 1),
word_windows AS (SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY a) AS w_ord, a AS lo_ms, z AS hi_ms FROM closed)"""

SLIDES = """slides0 AS (SELECT doc_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS talk_id, doc_id AS slide_id, text AS ocr_text FROM documents),
slides1 AS (SELECT *, row_number() OVER (PARTITION BY talk_id ORDER BY slide_id) - 1 AS idx FROM slides0),
slides AS (SELECT *, idx * 20000 AS first_seen_ms, CASE WHEN idx % 3 = 2 THEN 30000 ELSE 20000 END AS on_screen_ms,
CASE WHEN idx % 3 = 2 THEN [{'start_ms': idx * 20000, 'end_ms': idx * 20000 + 20000}, {'start_ms': idx * 20000 + 200000, 'end_ms': idx * 20000 + 210000}] ELSE [{'start_ms': idx * 20000, 'end_ms': idx * 20000 + 20000}] END AS spans FROM slides1)"""

SLIDE_SUMS = """sums AS (SELECT s.talk_id, s.slide_id, w.w_ord, sum(least(s.z, w.hi_ms) - greatest(s.a, w.lo_ms)) AS overlap_ms
FROM (SELECT talk_id, slide_id, unnest(spans).start_ms AS a, unnest(spans).end_ms AS z FROM slides) s JOIN chapter_windows w ON w.talk_id = s.talk_id AND s.a < w.hi_ms AND s.z > w.lo_ms GROUP BY ALL)"""

DOC_TOKENS = r"""doc_tokens AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS tok FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents))"""

TALK_TOKENS = r"""talk_tokens AS (SELECT talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY seg_idx, off) - 1 AS pos, tok, t FROM (
SELECT talk_id, seg_idx, t, unnest(range(0, len(w))) AS off, unnest(w) AS tok FROM (SELECT talk_id, seg_idx, start_ms AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM segs)))"""

TALK_QUOTES = r"""turn_words AS (SELECT conv_id, (conv_id::BIGINT * 1000 + turn) * 40000 + part * 4 AS base_id, words[part * 12 + 1 : part * 12 + 12] AS w FROM (
SELECT *, unnest(range(0, len(words) // 12)) AS part FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM conversations))),
quotes AS (SELECT base_id AS quote_id, conv_id AS talk_id, 'exact' AS kind, array_to_string(w[2:9], ' ') AS quote FROM turn_words
UNION ALL SELECT base_id + 1, conv_id, 'ellipsis', array_to_string(w[1:4], ' ') || ' … ' || array_to_string(w[7:10], ' ') FROM turn_words
UNION ALL SELECT base_id + 2, conv_id, 'fuzzy', array_to_string(w[1:5], ' ') || ' ' || w[6] || 'x ' || array_to_string(w[7:10], ' ') FROM turn_words
UNION ALL SELECT base_id + 3, conv_id, 'digits', array_to_string(w[1:5], ' ') || ' 40 ' || array_to_string(w[7:10], ' ') FROM turn_words)"""

#: Words spelt out, since RE2 knows word boundaries of ASCII only.
HARD_TOKENS = r"""hard AS (
SELECT doc_id, 'acronym' AS family, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{1,5}'))) AS token FROM documents UNION ALL
SELECT doc_id, 'version', unnest(regexp_extract_all(text, '\bv?\d+\.\d+(?:\.\d+)*\b')) FROM documents UNION ALL
SELECT doc_id, 'unit', unnest(regexp_extract_all(text, '(?i)\b\d+(?:\.\d+)?\s?(?:%|ms|s|sec|min|hours?|fps|gb|mb|kb|tb|k|b|x|×)\b')) FROM documents UNION ALL
SELECT doc_id, 'flag', unnest(regexp_extract_all(text, '--[a-z][\w-]+')) FROM documents UNION ALL
SELECT doc_id, 'identifier', unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*'), lambda x: regexp_full_match(x, '[\p{L}\p{M}\p{N}_]+([-_][\p{L}\p{M}\p{N}_]+)+'))) FROM documents)"""

FRAMES = """frames AS (SELECT label::BIGINT AS talk_id, n * 5 + j AS i, list_transform(range(1, len(embedding)), lambda k: embedding[k + 1] > embedding[k]) AS bits
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), range(0, 5) r(j))"""


def with_parts(*parts: str, recursive: bool = False) -> str:
    """WITH the parts, then the last one, which may begin with further parts after a comma."""
    out = []
    for p in parts[:-1]:
        out.append(p.strip().lstrip(",").strip())
    recursive = recursive or any("UNION ALL" in p and "walk" in p for p in parts)
    last = parts[-1].strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(out) + (last if last.startswith(",") else "\n" + last)
