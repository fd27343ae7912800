"""DuckDB SQL for the named queries, composed from the same fixtures."""

from __future__ import annotations

from ..operators.generate import DEFAULT_CARD_TYPES
from . import fixtures as fx

WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
BLANK = r"\t\x0b-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
CUT = "chr(1) || chr(2)"
HEADING = rf"^(#{{1,6}}[{WS}]+[^{WS}]|\p{{Nd}}+(\.\p{{Nd}}+)*[.)][{WS}]+[^{WS}]|[A-Z][A-Z0-9 ,\-:/&'']{{3,60}}$)"
AS_OF = "DATE '2024-06-30'"

CARDS = f"cards AS (SELECT {', '.join(fx.CARD_COLUMNS)} FROM documents)"
PAGES = f"pages AS (SELECT {', '.join(fx.PAGE_COLUMNS)} FROM documents)"
REVIEWS = f"every_review AS (SELECT id, {fx.RATING} AS rating, day, ts, nr FROM (SELECT CAST(user_id AS INT) AS id, event_type, CAST(ts AS DATE) AS day, ts, {fx.REVIEW_ORDER} AS nr FROM events WHERE user_id IS NOT NULL))"
LAST_REVIEWS = "reviews AS (SELECT id, rating, day, 1 AS nr FROM every_review QUALIFY row_number() OVER (PARTITION BY id ORDER BY nr DESC) = 1)"
ALL_REVIEWS = "reviews AS (SELECT * FROM every_review)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def normalize(x: str) -> str:
    for old, new in (("chr(13) || chr(10)", "chr(10)"), ("chr(13)", "chr(10)"), ("chr(12)", "chr(10)"), ("chr(160)", "' '")):
        x = f"replace({x}, {old}, {new})"
    x = rf"regexp_replace({x}, '([{WORD}])-\n([{WORD}])', '\1\2', 'g')"
    x = f"regexp_replace({x}, '(?m)[{BLANK}]+$', '', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')")


def fingerprint(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '\p{{Nd}}+', '#', 'g')"


def tokens(n: str) -> str:
    return f"greatest(1, CAST(floor(({n}) / 3.5::DOUBLE) AS BIGINT))"


def heading_line(x: str) -> str:
    return f"regexp_matches({x}, '{HEADING}')"


def heading(x: str) -> str:
    return f"(NOT contains({x}, chr(10)) AND {heading_line(strip(x))})"


def normal_form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^{WORD}{WS}]', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


def sentences(x: str) -> str:
    capital = "[A-Z" + chr(34) + r"''(\[]"
    return rf"string_split(regexp_replace({x}, '([.!?])[{WS}]+({capital})', '\1' || chr(1) || '\2', 'g'), chr(1))"


def quoted(x: str, sign: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '[{sign}"\r\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


def exploded(source: str, key: str, units: str, name: str = "x") -> str:
    """(key, pos from 0, name) of a list expression."""
    return f"(SELECT {key}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS {name} FROM (SELECT {key}, {units} AS l FROM {source}))"


def greedy(name: str, units: str, key: str, separator: int, most: int) -> str:
    """Recursive CTE over units(key, i from 0, n): the group of each unit."""
    new = f"{tokens(f'g.size + {separator} + u.n')} > {most}"
    return (
        f"{name} AS (SELECT {key}, i, n::BIGINT AS size, 0 AS grp FROM {units} WHERE i = 0 UNION ALL "
        f"SELECT {', '.join(f'u.{k}' for k in key.split(', '))}, u.i, CASE WHEN {new} THEN u.n ELSE g.size + {separator} + u.n END, g.grp + CASE WHEN {new} THEN 1 ELSE 0 END "
        f"FROM {name} g JOIN {units} u ON {' AND '.join(f'u.{k} = g.{k}' for k in key.split(', '))} AND u.i = g.i + 1)"
    )


def hard_split(name: str, source: str, key: str, most: int) -> str:
    """CTEs that end in {name}(key, pos, piece): sentences, then words, grouped under the ceiling. source(key, text)."""
    words = f"list_filter(regexp_split_to_array(piece, '[{WS}]+'), lambda w: w <> '')"
    return ", ".join(
        [
            f"{name}_s AS (SELECT {key}, pos AS i, x, length(x) AS n FROM {exploded(source, key, sentences('text'))})",
            greedy(f"{name}_g", f"{name}_s", key, 1, most),
            f"{name}_p AS (SELECT {key}, grp, string_agg(x, ' ' ORDER BY i) AS piece FROM {name}_g JOIN {name}_s USING ({key}, i) GROUP BY {key}, grp)",
            f"{name}_w AS (SELECT {key}, grp, pos AS i, x, length(x) AS n FROM {exploded(f'(SELECT * FROM {name}_p WHERE {tokens(chr(108) + "ength(piece)")} > {most})', f'{key}, grp', words)})",
            greedy(f"{name}_h", f"{name}_w", f"{key}, grp", 1, most).replace(f"{name}_h AS (SELECT {key}, grp, i, n::BIGINT AS size, 0 AS grp", f"{name}_h AS (SELECT {key}, grp, i, n::BIGINT AS size, 0 AS sub").replace("g.grp + CASE", "g.sub + CASE"),
            f"{name}_q AS (SELECT {key}, grp, sub, string_agg(x, ' ' ORDER BY i) AS piece FROM {name}_h JOIN {name}_w USING ({key}, grp, i) GROUP BY {key}, grp, sub)",
            f"{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY grp, sub) - 1 AS pos, piece FROM (SELECT {key}, grp, 0 AS sub, piece FROM {name}_p WHERE {tokens('length(piece)')} <= {most} UNION ALL SELECT {key}, grp, sub, piece FROM {name}_q))",
        ]
    )


MARKDOWN = "md AS (SELECT doc_id, 'd' || doc_id AS source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 6 = 0 THEN '# Part ' || (i - 1) || chr(10) || chr(10) ELSE '' END || CASE WHEN (i - 1) % 3 = 0 THEN '## Part ' || (i - 1) || chr(10) || chr(10) ELSE '' END || x), chr(10) || chr(10)) AS text FROM documents)"


def paragraphs(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
    groups = f"CASE WHEN len({lines}) = 0 THEN []::VARCHAR[] ELSE string_split(array_to_string(list_transform({lines}, lambda p, i: CASE WHEN i > 1 AND {heading_line('p')} THEN {CUT} || p ELSE p END), chr(10)), chr(10) || {CUT}) END"
    return f"CASE WHEN len({parts}) > 1 THEN {parts} ELSE {groups} END"


def blocks(source: str) -> str:
    """CTEs that end in blocks(source, pos, text)."""
    joined = f"list_transform(p, lambda x, i: x || CASE WHEN i = len(p) THEN '' WHEN NOT {heading('x')} THEN {CUT} WHEN {heading('p[i + 1]')} THEN chr(10) ELSE chr(10) || chr(10) END)"
    return f"paras AS (SELECT source, {paragraphs('text')} AS p FROM {source}), blocks AS (SELECT source, pos, x AS text FROM {exploded('(SELECT * FROM paras WHERE len(p) > 0)', 'source', f'string_split(array_to_string({joined}, {chr(39) * 2}), {CUT})')})"


def packed(merge: bool) -> str:
    """CTEs that end in chunks(source, index, text, token_count)."""
    runt = f"(last AND index > 0 AND {tokens('length(text)')} < 60 AND {tokens('length(text) + 2 + length(before)')} <= 240)"
    raw = "raw AS (SELECT source, grp AS index, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text FROM pk JOIN unit USING (source, i) GROUP BY source, grp)"
    parts = [
        MARKDOWN,
        blocks("md"),
        f"over AS (SELECT source, pos AS b, text FROM blocks WHERE {tokens('length(text)')} > 200)",
        hard_split("hs", "over", "source, b", 200),
        f"every AS (SELECT source, pos AS b, 0 AS sub, text AS x FROM blocks WHERE {tokens('length(text)')} <= 200 UNION ALL SELECT source, b, pos, piece FROM hs)",
        "unit AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY b, sub) - 1 AS i, x, length(x) AS n FROM every)",
        greedy("pk", "unit", "source", 2, 200),
        raw,
    ]
    if merge:
        parts += [
            "seen AS (SELECT *, lag(text) OVER (PARTITION BY source ORDER BY index) AS before, index = max(index) OVER (PARTITION BY source) AS last FROM raw)",
            f"flag AS (SELECT *, {runt} AS runt FROM seen)",
            "chunks AS (SELECT source, index, CASE WHEN coalesce(lead(runt) OVER (PARTITION BY source ORDER BY index), FALSE) THEN text || chr(10) || chr(10) || lead(text) OVER (PARTITION BY source ORDER BY index) ELSE text END AS text, runt FROM flag)",
            f"final AS (SELECT source, index::BIGINT AS index, text, {tokens('length(text)')} AS token_count FROM chunks WHERE NOT coalesce(runt, FALSE))",
        ]
    else:
        parts.append(f"final AS (SELECT source, index::BIGINT AS index, text, {tokens('length(text)')} AS token_count FROM raw)")
    return "WITH RECURSIVE " + ", ".join(parts)


RUNNING = (
    f"{PAGES}, lines AS (SELECT source, page, pos, x FROM {exploded('pages', 'source, page', 'string_split(text, chr(10))')}), "
    f"total AS (SELECT source, count(*) AS n FROM pages GROUP BY source), "
    f"filled AS (SELECT source, page, {fingerprint('x')} AS fp, row_number() OVER (PARTITION BY source, page ORDER BY pos) AS a, row_number() OVER (PARTITION BY source, page ORDER BY pos DESC) AS z FROM lines WHERE {strip('x')} <> ''), "
    "hits AS (SELECT source, fp, count(DISTINCT page) AS n FROM filled WHERE a <= 2 OR z <= 2 GROUP BY source, fp), "
    "rep AS (SELECT h.source, h.fp FROM hits h JOIN total t USING (source) WHERE t.n >= 3 AND h.n >= greatest(2, floor(t.n * 0.6::DOUBLE))), "
    f"marked AS (SELECT l.*, {fingerprint('l.x')} AS fp, count(*) OVER (PARTITION BY source, page) AS m FROM lines l), "
    "kept AS (SELECT source, page, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT ((pos < 2 OR pos >= m - 2) AND r.fp IS NOT NULL)), '') AS text FROM marked LEFT JOIN rep r USING (source, fp) GROUP BY source, page)"
)
CLEAN_PAGES = f"{RUNNING}, clean AS (SELECT source, page, {normalize('text')} AS text FROM kept)"

REASON = f"CASE WHEN length(answer) < 15 THEN 'answer too short' WHEN {normal_form('answer')} <> '' AND contains({normal_form('question')}, {normal_form('answer')}) THEN 'answer restates question' END"
KEEPERS = f"keyed AS (SELECT *, CASE WHEN topic IS NOT NULL THEN min(id) OVER (PARTITION BY lower(topic), {normal_form('question')}) END AS keeper FROM cards), unique_cards AS (SELECT * FROM keyed WHERE topic IS NULL OR id = keeper)"
COVERAGE = "SELECT topic, count(*) AS card_count, count(*) FILTER (WHERE difficulty = 'easy') AS easy, count(*) FILTER (WHERE difficulty = 'medium') AS medium, count(*) FILTER (WHERE difficulty = 'hard') AS hard, array_to_string(list_sort(list(DISTINCT card_type)), '|') AS card_types FROM {} WHERE topic IS NOT NULL GROUP BY topic"


def folded(reviews: str = ALL_REVIEWS) -> str:
    """CTEs that end in state(id, repetitions, ease_factor, interval_days, due, last)."""
    q = "CASE r.rating WHEN 'again' THEN 0 WHEN 'hard' THEN 3 WHEN 'good' THEN 4 ELSE 5 END"
    ease = f"greatest(1.3::DOUBLE, s.ef + (0.1::DOUBLE - (5 - {q}) * (0.08::DOUBLE + (5 - {q}) * 0.02::DOUBLE)))"
    days = f"CASE WHEN r.rating = 'again' OR s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE greatest(1, CAST(round_even(s.iv * {ease}, 0) AS INT)) END"
    return (
        f"WITH RECURSIVE {CARDS}, {REVIEWS}, {reviews}, step AS (SELECT DISTINCT id, 0::BIGINT AS nr, 0 AS reps, 2.5::DOUBLE AS ef, 0 AS iv, NULL::DATE AS due, NULL::DATE AS last FROM reviews UNION ALL "
        f"SELECT s.id, r.nr, CASE WHEN r.rating = 'again' THEN 0 ELSE s.reps + 1 END, {ease}, {days}, r.day + ({days}), r.day FROM step s JOIN reviews r ON r.id = s.id AND r.nr = s.nr + 1), "
        "state AS (SELECT c.id, coalesce(s.reps, 0)::BIGINT AS repetitions, coalesce(s.ef, 2.5::DOUBLE) AS ease_factor, coalesce(s.iv, 0)::BIGINT AS interval_days, s.due AS due_date, s.last AS last_reviewed "
        "FROM cards c LEFT JOIN (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY id ORDER BY nr DESC) = 1) s USING (id)) "
    )


STATE = "SELECT id, repetitions, ease_factor, interval_days, due_date::VARCHAR AS due_date, last_reviewed::VARCHAR AS last_reviewed FROM state"
GENERATION = (
    f"{CARDS}, gen AS (SELECT chunk_index, chunk_index % 7 = 3 AS refused, count(*) AS cards, count(*) FILTER (WHERE id % 4 = 0) AS dropped, sum(length(question)) AS i, sum(length(answer)) AS o, "
    "sum(CASE WHEN id % 2 = 0 THEN length(question) ELSE 0 END) AS r, sum(CASE WHEN id % 2 = 1 THEN length(question) ELSE 0 END) AS c FROM cards GROUP BY chunk_index)"
)
LABEL = "'p. 1'"
TYPES = ", ".join(DEFAULT_CARD_TYPES)
PROMPT = f"'Write about 8 study cards from the passage below (p. 1). Mix these card types where the passage allows: {TYPES}. Write fewer than 8 rather than weak or repeated ones.' || chr(10) || chr(10) || '---' || chr(10) || text || chr(10) || '---'"
GLOBAL = f"{packed(True)}, numbered AS (SELECT f.*, row_number() OVER (ORDER BY md.doc_id, f.index) - 1 AS nr FROM final f JOIN md USING (source))"

VALID = "coalesce(length(question) > 0 AND length(answer) > 0 AND length(topic) > 0 AND length(source_excerpt) > 0, FALSE)"

ORACLES: dict[str, str] = {
    "q01_normalize_text": f"SELECT doc_id, {normalize('text')} AS text FROM (SELECT doc_id, {fx.ROUGH_TEXT} AS text FROM documents)",
    "q02_fingerprint": f"SELECT doc_id, pos, {fingerprint('x')} AS fingerprint FROM {exploded('documents', 'doc_id', 'string_split(text, chr(10))')}",
    "q03_estimate_tokens": f"SELECT doc_id, {tokens('length(text)')} AS tokens FROM documents",
    "q04_heading_flag": f"WITH {MARKDOWN} SELECT doc_id, pos, {heading(strip('x'))} AS heading FROM {exploded('md', 'doc_id', 'string_split(text, chr(10) || chr(10))')}",
    "q05_card_text_normal_form": f"SELECT doc_id, {normal_form('text')} AS form FROM documents",
    "q06_sentence_split": f"SELECT doc_id, pos, x AS sentence FROM {exploded('documents', 'doc_id', sentences('text'))}",
    "q07_quality_kept": f"WITH {CARDS} SELECT id, question, answer FROM cards WHERE ({REASON}) IS NULL",
    "q08_quality_dropped": f"WITH {CARDS} SELECT id, {REASON} AS reason FROM cards WHERE ({REASON}) IS NOT NULL",
    "q09_coverage_by_topic": f"WITH {CARDS} {COVERAGE.format('cards')}",
    "q10_card_mix": f"WITH {CARDS} SELECT card_type, count(*) AS cards FROM cards GROUP BY card_type",
    "q11_difficulty_mix": f"WITH {CARDS} SELECT d AS difficulty, count(id) AS cards FROM (VALUES ('easy'), ('medium'), ('hard')) l(d) LEFT JOIN cards ON difficulty = d GROUP BY d",
    "q12_keyword_search": rf"WITH {CARDS} SELECT question, answer, topic, card_type FROM cards WHERE regexp_matches(question, 'the(re)?\b', 'i') OR regexp_matches(answer, 'the(re)?\b', 'i')",
    "q13_card_validation": f"WITH {CARDS} SELECT id, id % 13 <> 0 AND id % 17 <> 0 AND coalesce(length(question) > 0 AND length(answer) > 0 AND length(topic) > 0 AND length(source_excerpt) > 0, FALSE) AS valid FROM cards",
    "q14_srs_attach": f"WITH {CARDS} SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS repetitions, CASE WHEN id % 3 = 0 THEN 2.25 ELSE 2.5 END::DOUBLE AS ease_factor, 0::BIGINT AS interval_days, NULL::VARCHAR AS due_date, NULL::VARCHAR AS last_reviewed FROM cards",
    "q15_srs_single_review": folded(LAST_REVIEWS) + STATE,
    "q16_srs_fold": folded() + STATE,
    "q17_due_cards": folded() + f"SELECT id, due_date::VARCHAR AS due_date FROM state WHERE due_date IS NULL OR due_date <= {AS_OF}",
    "q18_review_progress": folded() + f"SELECT count(*) AS total, count(*) FILTER (WHERE repetitions = 0) AS new, count(*) FILTER (WHERE due_date IS NULL OR due_date <= {AS_OF}) AS due, count(*) FILTER (WHERE repetitions >= 3 AND interval_days > 7) AS mastered FROM state",
    "q19_clean_stats": f"WITH {CARDS}, {KEEPERS} SELECT (SELECT count(*) FROM cards) - (SELECT count(*) FROM unique_cards) AS duplicates_dropped, (SELECT count(*) FROM unique_cards WHERE ({REASON}) IS NOT NULL) AS quality_dropped",
    "q20_document_stats": f"WITH {CLEAN_PAGES} SELECT source, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text_sha256, count(*) AS page_count, sum(length(text))::BIGINT AS char_count FROM clean WHERE text <> '' GROUP BY source",
    "q21_running_lines_removed": f"WITH {RUNNING} SELECT source, page::BIGINT AS page, text FROM kept",
    "q22_paragraphs": f"WITH {MARKDOWN}, both_texts AS (SELECT doc_id, text FROM md UNION ALL SELECT -1 - doc_id, text FROM documents) SELECT doc_id, pos, x AS text FROM {exploded('both_texts', 'doc_id', paragraphs('text'))}",
    "q23_heading_blocks": f"WITH {MARKDOWN}, {blocks('md')} SELECT source, pos, text FROM blocks",
    "q24_oversized_split": f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents), {hard_split('hs', 'src', 'doc_id', 60)} SELECT doc_id, pos, piece FROM hs",
    "q25_greedy_pack": packed(False) + " SELECT source, index, 1::BIGINT AS start_page, 1::BIGINT AS end_page, token_count, text FROM final",
    "q26_runt_merge": packed(True) + " SELECT source, index, 1::BIGINT AS start_page, 1::BIGINT AS end_page, token_count, text FROM final",
    "q27_chunk_index_global": GLOBAL + f" SELECT nr AS index, source, token_count, {LABEL} AS label FROM numbered",
    "q27b_chunk_totals": GLOBAL + " SELECT count(DISTINCT source) AS documents, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM numbered",
    "q28_exact_dup_clusters": f"WITH {CARDS}, {KEEPERS} SELECT keeper::BIGINT AS keeper, string_agg(id::VARCHAR, '|' ORDER BY id) AS ids FROM keyed WHERE topic IS NOT NULL GROUP BY keeper HAVING count(*) > 1",
    "q30_deduplicate_kept": f"WITH {CARDS}, {KEEPERS} SELECT id, question FROM unique_cards",
    "q31_deduplicate_dropped": f"WITH {CARDS}, {KEEPERS} SELECT id, keeper AS duplicate_of FROM keyed WHERE topic IS NOT NULL AND id <> keeper",
    "q32_grounding_filter": f"WITH {CARDS} SELECT id, {collapse('source_excerpt')} <> '' AND contains({collapse('text')}, {collapse('source_excerpt')}) AS is_grounded FROM cards JOIN documents ON doc_id = id",
    "q33_generation_totals": f"WITH {GENERATION}, t AS (SELECT sum(i)::BIGINT AS total_input_tokens, sum(o)::BIGINT AS total_output_tokens, sum(r)::BIGINT AS total_cache_read_tokens, sum(c)::BIGINT AS total_cache_creation_tokens, sum(dropped)::BIGINT AS total_dropped_ungrounded, sum(cards)::BIGINT AS total_cards FROM gen WHERE NOT refused) SELECT t.*, (SELECT count(*) FROM gen WHERE refused) AS errors, 100.0::DOUBLE * total_cache_read_tokens / total_input_tokens AS cache_percent FROM t",
    "q34_generation_errors": f"WITH {GENERATION} SELECT chunk_index::BIGINT AS chunk_index, 'chunk ' || chunk_index || ' (p. 1): generation refused (category=None)' AS error FROM gen WHERE refused",
    "q35_deck_from_summary": f"WITH {CARDS} SELECT row_number() OVER (ORDER BY chunk_index, id) - 1 AS id, question, chunk_index::BIGINT AS chunk_index, CASE WHEN chunk_index < 30 THEN 'file' || chunk_index END AS document FROM cards WHERE chunk_index % 7 <> 3",
    "q36_anki_rows": f"WITH {CARDS} SELECT id, {quoted('question', ',')} || ',' || {quoted('answer', ',')} || ',' || {quoted(f'(card_type || {chr(39)} {chr(39)} || difficulty || {chr(39)} {chr(39)} || replace({strip("topic")}, {chr(39)} {chr(39)}, {chr(39)}_{chr(39)}))', ',')} AS line FROM cards WHERE topic IS NOT NULL",
    "q37_quizlet_rows": rf"WITH {CARDS} SELECT id, {quoted(collapse('question'), chr(92) + 't')} || chr(9) || {quoted(collapse('answer'), chr(92) + 't')} AS line FROM cards",
    "q38_json_rows": f"WITH {CARDS} SELECT id, question, answer, topic FROM cards",
    "q39_deck_roundtrip_parquet": f"WITH {CARDS} SELECT * FROM cards",
    "q39b_deck_roundtrip_csv": f"WITH {CARDS} SELECT * FROM cards",
    "q40_clean_pipeline": f"WITH {CARDS}, {KEEPERS}, good AS (SELECT * FROM unique_cards WHERE ({REASON}) IS NULL) {COVERAGE.format('good')}",
    "q41_prompts": GLOBAL + f" SELECT nr AS index, sha256({PROMPT}) AS prompt_sha256 FROM numbered",
    "q42_upload_totals": f"WITH {CLEAN_PAGES} SELECT count(DISTINCT source) AS files, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM clean WHERE text <> ''",
    "q43_generate_deck": GLOBAL
    + " SELECT nr AS chunk_index, CASE WHEN nr % 7 = 3 THEN 0 ELSE 1 END::BIGINT AS cards, CASE WHEN nr % 7 = 3 THEN 0 ELSE 1 END::BIGINT AS dropped_ungrounded, length(text) AS input_tokens, CASE WHEN nr % 7 = 3 THEN 'refusal' ELSE 'end_turn' END AS stop_reason, CASE WHEN nr % 7 = 3 THEN 'chunk ' || nr || ' (p. 1): generation refused (category=rule)' END AS error FROM numbered",
    "q45_ingest_files": f"SELECT 'n' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.TXT' END AS source, 1::BIGINT AS page, {normalize('text')} AS text FROM (SELECT doc_id, {fx.ROUGH_TEXT} AS text FROM documents)",
    "q45b_ingest_errors": "SELECT 'n' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pptx' ELSE '.md' END AS source, 'n' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pptx: unsupported extension ''.pptx''. Supported: .markdown, .md, .pdf, .txt' ELSE '.md: no extractable text.' END AS error FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "q46_resume_snapshot": f"WITH {CARDS} SELECT id, 0::BIGINT AS repetitions, 2.5::DOUBLE AS ease_factor, 0::BIGINT AS interval_days, NULL::VARCHAR AS due_date, NULL::VARCHAR AS last_reviewed FROM cards WHERE {VALID}",
    "q47_record_review": f"WITH {CARDS} SELECT id, CASE WHEN id = 7 THEN 1 ELSE 0 END::BIGINT AS repetitions, CASE WHEN id = 7 THEN 2.5::DOUBLE + 0.1::DOUBLE ELSE 2.5::DOUBLE END AS ease_factor, CASE WHEN id = 7 THEN 1 ELSE 0 END::BIGINT AS interval_days, CASE WHEN id = 7 THEN '2024-05-02' END AS due_date, CASE WHEN id = 7 THEN '2024-05-01' END AS last_reviewed FROM cards",
    "q48_export_gate": f"WITH {CARDS} SELECT id FROM cards WHERE id % 13 = 0 OR id % 17 = 0 OR NOT {VALID}",
    "q49_injected_counter": GLOBAL + f" SELECT nr AS index, source, token_count, {LABEL} AS label FROM numbered",
    "q50_review_stream": folded() + "SELECT id::BIGINT AS id, reps::BIGINT AS repetitions, ef AS ease_factor, iv::BIGINT AS interval_days, due::VARCHAR AS due_date, last::VARCHAR AS last_reviewed FROM step WHERE nr > 0",
    "q51_activity_windows": f"WITH {REVIEWS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS end, rating, count(*) AS reviews FROM every_review GROUP BY ALL",
    "q44_edits_merged": f"WITH {CARDS} SELECT id, CASE WHEN id % 10 = 0 THEN 'edited ' || question ELSE question END AS question, answer FROM cards WHERE id % 25 <> 5",
}
