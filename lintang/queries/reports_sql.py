"""DuckDB SQL of the reports and record operators, written from the rules and not from the library's patterns."""

from __future__ import annotations

from lintang.queries.sql import STEPS, boxed, chain, graded, loose, q, shape



def trim(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"


def key(c: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')))"


BROKEN = r"\x{FFFD}|Ã[\x{80}-\x{BF}]|â€|Â[\x{80}-\x{BF}]|[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]"
OUTSIDE = (
    r"(?i)\b(menurut|berdasarkan|sesuai)\b.*\b(laporan|tabel|grafik|gambar|diagram|teks|bacaan|paragraf|data|kutipan|artikel|wacana|cerita)\b"
    r"|\b(tabel|grafik|gambar|diagram|teks|bacaan|paragraf|wacana)\b\s+(di\s+atas|berikut|di\s+bawah|tersebut)"
)


def broken(*columns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce({c}, ''), {q(BROKEN)})" for c in columns) + ")"


GOLD = f"""{graded('gold', STEPS, 'jawaban')},
    f AS (SELECT *, coalesce(cara, '') <> '' AND {trim('jawaban')} <> '' AS checked, coalesce(cara, '') <> '' AND {trim('jawaban')} <> '' AND correct AS matched, list_filter([
        CASE WHEN {trim('jawaban')} = '' THEN 'jawaban_kosong' END, CASE WHEN {trim('soal')} = '' THEN 'soal_kosong' END, CASE WHEN {trim('soal')} <> '' AND length({trim('soal')}) < 20 THEN 'soal_pendek' END,
        CASE WHEN {broken('soal', 'jawaban', 'cara')} THEN 'mojibake' END, CASE WHEN regexp_matches({trim('soal')}, {q(OUTSIDE)}) THEN 'butuh_konteks_luar' END, CASE WHEN {shape('jawaban')} = 'text' THEN 'jawaban_teks_bebas' END,
        CASE WHEN coalesce(cara, '') <> '' AND {trim('jawaban')} <> '' AND pred IS NULL THEN 'cara_tanpa_jawaban' END,
        CASE WHEN coalesce(cara, '') <> '' AND {trim('jawaban')} <> '' AND pred IS NOT NULL AND NOT correct THEN 'cara_vs_gold_mismatch' END], lambda x: x IS NOT NULL) AS flags FROM graded)"""
SAID = "coalesce(list_filter(messages, lambda m: m.role = 'assistant')[-1].content, '')"
ASKED = "coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '')"
BODY = f"CASE WHEN contains({ASKED}, chr(10) || chr(10)) THEN substr({ASKED}, strpos({ASKED}, chr(10) || chr(10)) + 2) ELSE {ASKED} END"
CHAT = f"""c0 AS (SELECT *, {SAID} AS said, {trim(BODY)} AS asked FROM chatml), c1 AS (SELECT *, {boxed('said')} AS box FROM c0),
    c AS (SELECT *, list_filter([CASE WHEN {trim('said')} = '' THEN 'assistant_kosong' END, CASE WHEN box IS NULL THEN 'tanpa_boxed' END, CASE WHEN box IS NOT NULL AND {trim('box')} = '' THEN 'boxed_kosong' END,
        CASE WHEN {broken('asked', 'said')} THEN 'mojibake' END, CASE WHEN arm = 'nocot' AND length({trim(chain('said', (r"(?s)\\boxed\s*\{.*\}", '')))}) > 15 THEN 'nocot_ada_penalaran' END,
        CASE WHEN arm = 'cot' AND box IS NOT NULL AND length({trim('said')}) - length(box) < 40 THEN 'cot_tanpa_penalaran' END], lambda x: x IS NOT NULL) AS flags FROM c1)"""


def has(flag: str) -> str:
    return f"count(*) FILTER (list_contains(flags, '{flag}'))"


def chat_rates(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round({has('tanpa_boxed')} / count(*), 3) AS tanpa_boxed_rate, round({has('mojibake')} / count(*), 3) AS mojibake_rate, round((count(*) - count(DISTINCT {key('asked')})) / count(*), 3) AS dup_rate,
        round(({has('nocot_ada_penalaran')} + {has('cot_tanpa_penalaran')}) / count(*), 3) AS format_issue_rate, floor(median(length(said)))::int AS asst_len_median FROM c GROUP BY {by}"""


REASONS = f"""r AS (SELECT split, CASE WHEN {trim('jawaban')} = '' THEN 1 WHEN length({trim('soal')}) < 20 THEN 1 WHEN {broken('soal', 'jawaban', 'cara')} THEN 1 WHEN regexp_matches({trim('soal')}, {q(OUTSIDE)}) THEN 1
    WHEN coalesce(cara, '') <> '' AND pred IS NOT NULL AND NOT correct THEN 1 WHEN {shape('jawaban')} = 'text' THEN 1 ELSE 0 END AS dropped FROM graded)"""
FORMULAS = r"\$[^$]+\$"
TOKENS = "dan atau yang dengan dari untuk pada adalah ini itu akan tidak jika maka nilai carilah tentukan hitunglah buktikan diketahui misalkan penyelesaian sebuah suatu bilangan persamaan".split()
ID_CUES = r"(?i)\b(adalah|maka|sehingga|dengan|untuk|kita|persamaan|jawaban|nilai|langkah|diketahui|jadi|misalkan|karena|bilangan|sebuah|pada|dari|yang)\b"
EN_CUES = r"(?i)\b(the|is|we|so|therefore|equation|answer|value|step|since|let|because|first|then|thus|need|find|number|given|where|which|that)\b"


def found_words(c: str) -> str:
    bare = r"\$[^$]+\$|\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+|[0-9+\-*/^_=().]+"
    return f"regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), {q(bare)}, ' ', 'g')), '[a-z]+')"


def labelled(c: str, other: str) -> str:
    return f"CASE WHEN len({found_words(c)}) = 0 THEN 'unknown' WHEN list_has_any({found_words(c)}, {TOKENS!r}) THEN 'id' ELSE {other} END"


CUES = f"CASE WHEN len(regexp_extract_all(coalesce(soal, ''), {q(ID_CUES)})) >= len(regexp_extract_all(coalesce(soal, ''), {q(EN_CUES)})) THEN 'id' ELSE 'en' END"
KEPT = f"""c AS (SELECT DISTINCT id, candidate_idx, soal, jawaban, source, text FROM candidate WHERE id IS NOT NULL AND candidate_idx IS NOT NULL), p AS (SELECT *, {boxed('text', '[^{]*', True)} AS box FROM c),
    {graded('p', 'box', 'jawaban')}, s AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM correct x WHERE x.id = graded.id AND x.candidate_idx = graded.candidate_idx) THEN 'skipped_done' WHEN box IS NULL THEN 'no_boxed' WHEN {trim('jawaban')} = '' THEN 'no_gold'
        WHEN {loose('box')} = {loose('jawaban')} AND {loose('box')} <> '' THEN 'by_prefilter' WHEN correct THEN 'by_judge' ELSE 'wrong' END AS how FROM graded)"""
DRIVE = r"coalesce(nullif(regexp_extract(url, 'drive\.google\.com/file/d/([^/?#]+)', 1), ''), nullif(regexp_extract(url, 'drive\.google\.com/open\?id=([^&]+)', 1), ''), nullif(regexp_extract(url, 'drive\.google\.com/uc\?.*?id=([^&]+)', 1), ''))"
URL = r"regexp_replace(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substr(trim(url), length(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1), '/+$', '')"
LINES = r"list_filter(string_split(coalesce(raw_text, ''), chr(10)), lambda x: trim(x) <> '')"
ROUTE = f"""CASE WHEN length({trim('raw_text')}) < 40 THEN 'skip' WHEN coalesce(has_image, false) OR (CASE WHEN len({LINES}) = 0 THEN 1.0 ELSE len(list_filter({LINES}, lambda x: length(trim(x)) <= 3)) / len({LINES}) END) > 0.3 THEN 'image' ELSE 'text' END"""
MENTIONS = r"(?i)\b(gambar|diagram|grafik|tabel|foto|ilustrasi|fig|figure)\b"
COT = "Selesaikan soal matematika berikut. Tunjukkan langkah-langkah penyelesaian secara rinci dan sistematis dalam Bahasa Indonesia. Pastikan jawaban akhir (dan hanya jawaban) berada di dalam \\boxed{}."
IMAGES = (
    r"(?i)\b(lihat\s+(gambar|foto|tabel|diagram|grafik)|perhatikan\s+(gambar|foto|tabel|diagram|grafik)|pada\s+gambar|gambar\s+(di\s+)?(atas|bawah|samping|berikut)|sesuai\s+(dengan\s+)?gambar|berdasarkan\s+gambar|"
    r"ditunjukkan\s+(pada\s+)?gambar|gambar\s+\d+|pada\s+foto|foto\s+di\s+(atas|bawah)|yang\s+saya\s+kirim|terlampir)\b"
)
BAD_PAGE = r"""length(t) < 500 OR len(regexp_extract_all(t, '[A-Za-z]{2,}')) < 50 OR len(regexp_extract_all(t, '\(cid:\d+\)')) / greatest(length(t), 1) * 1000 > 3.0 OR len(regexp_extract_all(t, '\x{FFFD}')) / greatest(length(t), 1) * 1000 > 1.0 OR len(regexp_extract_all(t, '\p{L}')) / greatest(length(t), 1) < 0.20"""

ORACLE = {
    "gold_flag_counts": f"WITH {GOLD} SELECT split, flag, count(*) AS n_rows FROM (SELECT split, unnest(flags) AS flag FROM f) GROUP BY 1, 2",
    "gold_flagged": f"WITH {GOLD} SELECT rid, array_to_string(flags, ',') AS flags FROM f WHERE len(flags) > 0",
    "gold_summary": f"""WITH {GOLD} SELECT split, count(*) AS n, count(*) - count(DISTINCT {key('soal')}) AS dup_soal, floor(median(length({trim('soal')})))::int AS soal_len_median, sum(checked::int)::bigint AS cara_checked,
        sum(matched::int)::bigint AS cara_match_gold, round(sum(matched::int) / nullif(sum(checked::int), 0), 3) AS self_consistency FROM f GROUP BY split""",
    "gold_rates": f"""WITH {GOLD} SELECT split, count(*) AS n, round(sum(matched::int) / nullif(sum(checked::int), 0), 3) AS self_consistency, round({has('butuh_konteks_luar')} / count(*), 3) AS unanswerable_rate, round({has('jawaban_kosong')} / count(*), 3) AS empty_jawaban_rate,
        round({has('jawaban_teks_bebas')} / count(*), 3) AS text_answer_rate, round({has('mojibake')} / count(*), 3) AS mojibake_rate, round((count(*) - count(DISTINCT {key('soal')})) / count(*), 3) AS dup_rate FROM f GROUP BY split""",
    "chat_flag_counts": f"WITH {CHAT} SELECT arm, flag, count(*) AS n_rows FROM (SELECT arm, unnest(flags) AS flag FROM c) GROUP BY 1, 2",
    "chat_rates": f"WITH {CHAT} {chat_rates('arm')}",
    "arm_delta": f"""WITH {CHAT}, rates AS ({chat_rates('split, arm')}), long AS (UNPIVOT (SELECT split, arm, tanpa_boxed_rate, mojibake_rate, dup_rate FROM rates) ON tanpa_boxed_rate, mojibake_rate, dup_rate INTO NAME metric VALUE v)
        SELECT a.split, a.metric, a.v AS cot, b.v AS nocot, round(a.v - b.v, 4) AS delta FROM long a JOIN long b ON a.split = b.split AND a.metric = b.metric WHERE a.arm = 'cot' AND b.arm = 'nocot'""",
    "cleaning_report": f"WITH {graded('gold', STEPS, 'jawaban')}, {REASONS} SELECT split, count(*) AS n_before, (count(*) - sum(dropped))::bigint AS n_after, sum(dropped)::bigint AS n_dropped, round((count(*) - sum(dropped)) / count(*), 3) AS keep_rate FROM r GROUP BY split",
    "verdict_rates": r"""WITH v AS (SELECT source, coalesce(nullif(lower(regexp_extract(coalesce(text, ''), '(?i)gold\s*=\s*(benar|salah|ragu)', 1)), ''), 'ragu') AS g, coalesce(nullif(lower(regexp_extract(coalesce(text, ''), '(?i)lengkap\s*=\s*(ya|tidak)', 1)), ''), 'ya') AS l FROM candidate)
        SELECT source, count(*) AS n, round(avg((g = 'benar')::int), 3) AS gold_benar_rate, round(avg((g = 'salah')::int), 3) AS gold_salah_rate, round(avg((g = 'ragu')::int), 3) AS gold_ragu_rate, round(avg((l = 'ya')::int), 3) AS soal_lengkap_rate FROM v GROUP BY source""",
    "judge_replies": "SELECT source, count(*) AS n_rows, sum(contains(lower(coalesce(text, '')), 'benar')::int)::bigint AS correct FROM candidate GROUP BY source",
    "judge_prompts": f"""SELECT rid, 'SOAL:' || chr(10) || substr({trim('soal')}, 1, 1800) || chr(10) || 'JAWABAN: ' || coalesce(nullif(substr({trim('jawaban')}, 1, 80), ''), '(kosong)') || chr(10) || coalesce(nullif(substr({trim('cara')}, 1, 1200), ''), '(kosong)') AS prompt FROM gold""",
    "language_rates": "SELECT source, count(*) AS n, round(avg((coalesce(lang, 'unknown') = 'id')::int), 3) AS language_rate FROM documents WHERE length(text) >= 20 GROUP BY source",
    "language_labels": f"SELECT split, {labelled('soal', CUES)} AS label, count(*) AS n_rows FROM gold GROUP BY 1, 2",
    "detected_languages": f"SELECT source, {labelled('text', chr(39).join(['CASE WHEN lang = ', 'en', ' THEN ', 'en', ' WHEN lang IS NOT NULL THEN ', 'id', ' ELSE ', 'unknown', ' END']))} AS label, count(*) AS n_rows FROM documents GROUP BY 1, 2",
    "rule_reasons_detected": rf"""WITH t AS (SELECT jenis, lang, coalesce(text, '') AS t FROM documents) SELECT jenis, CASE WHEN length({trim('t')}) < 10 THEN 'too_short' WHEN len(regexp_extract_all(t, '(?m)^\s*[A-Ea-e][.)]\s+\S')) >= 3 THEN 'multiple_choice'
        WHEN regexp_matches(t, '(?i)\b(pernyataan\s+berikut\s+(yang\s+)?(benar|salah)|benar\s+atau\s+salah|true\s+or\s+false|tentukan\s+(mana\s+yang\s+)?(benar|salah))\b') THEN 'true_false' WHEN regexp_matches(t, {q(IMAGES)}) THEN 'needs_image'
        WHEN coalesce(lang = 'id', false) THEN 'passed' ELSE 'not_indonesian' END AS reason, count(*) AS rows FROM t GROUP BY 1, 2""",
    "coverage_scores": """WITH runs AS (SELECT candidate_idx AS run, id FROM correct WHERE id IS NOT NULL), pools AS (SELECT DISTINCT candidate_idx AS run, id FROM candidate WHERE id IS NOT NULL AND candidate_idx IS NOT NULL),
        common AS (SELECT id FROM pools GROUP BY id HAVING count(*) = (SELECT count(DISTINCT run) FROM runs)), m AS (SELECT run, count(DISTINCT id) AS coverage_raw, count(*) AS total_correct, count(DISTINCT id) FILTER (id IN (SELECT id FROM common)) AS coverage_common FROM runs GROUP BY run),
        s AS (SELECT m.*, (SELECT count(*) FROM pools WHERE pools.run = m.run) AS pool_size FROM m) SELECT *, run = (SELECT run FROM s ORDER BY coverage_common DESC, total_correct DESC, run DESC LIMIT 1) AS winner FROM s""",
    "embedding_twins": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS v FROM embeddings)
        SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 4) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.5""",
    "progress_log": "SELECT DISTINCT id, candidate_idx FROM progress",
    "json_lines_skipped": "SELECT rid, coalesce(soal, '') AS soal FROM gold",
    "json_lines_kept": "SELECT false AS broken, count(*) AS n_rows, NULL::int AS most_chars FROM gold UNION ALL SELECT true, count(*), max(least(14 + 20 * length(slug), 200))::int FROM sources",
    "json_array_slice": "SELECT (n - 1)::int AS position, item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS n FROM benchmark) WHERE n - 1 >= 10 AND n - 1 < 60",
    "csv_union": "SELECT '' AS slug, item_id::varchar AS item_id, '' AS level, coalesce(text, '') AS text, '' AS trust FROM benchmark UNION ALL SELECT coalesce(slug, ''), '', coalesce(level, ''), '', coalesce(trust::varchar, '') FROM sources",
    "partitioned_gold": "SELECT coalesce(hard, false)::varchar AS hard, count(*) AS n_rows FROM gold GROUP BY 1",
    "sampling_counters": f"""WITH {KEPT} SELECT source, count(*) AS total, {', '.join(f"count(*) FILTER (how = '{h}') AS {h}" for h in ('skipped_done', 'no_boxed', 'no_gold', 'by_prefilter', 'by_judge', 'wrong'))},
        count(*) FILTER (how IN ('by_prefilter', 'by_judge')) AS kept, count(DISTINCT id) FILTER (how IN ('by_prefilter', 'by_judge')) AS problems_covered FROM s GROUP BY source""",
    "merged_results": """WITH g AS (SELECT source, count(*) AS n FROM gold GROUP BY 1), d AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT source, count(*) AS n FROM chatml GROUP BY 1), k AS (SELECT source FROM g UNION SELECT source FROM d UNION SELECT source FROM c)
        SELECT k.source, CASE WHEN c.n IS NULL AND d.n IS NULL THEN g.n END AS n_gold, CASE WHEN c.n IS NULL THEN d.n END AS n_documents, c.n AS n_chat FROM k LEFT JOIN g USING (source) LEFT JOIN d USING (source) LEFT JOIN c USING (source) WHERE k.source IS NOT NULL""",
    "provenance_summary": f"""WITH t AS (SELECT {trim('soal')} AS k, source FROM gold), a AS (SELECT k FROM t WHERE source LIKE 'osn%'), b AS (SELECT k FROM t WHERE starts_with(source, 'un_')), s AS (SELECT k FROM t WHERE source LIKE 'paket%')
        SELECT count(*) AS total, (count(*) FILTER (k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM s)))::bigint AS unknown, count(*) FILTER (k IN (SELECT k FROM a) AND k IN (SELECT k FROM b)) AS conflicts,
        round(100.0 * count(*) FILTER (k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM s)) / count(*), 1)::double AS unknown_pct FROM t""",
    "solved_or_tried": "SELECT id FROM correct UNION SELECT id FROM candidate",
    "unsolved": "SELECT id, 'left' AS side FROM (SELECT id FROM correct EXCEPT SELECT id FROM candidate) UNION ALL SELECT id, 'right' FROM (SELECT id FROM candidate EXCEPT SELECT id FROM correct)",
    "distinct_lines": f"SELECT DISTINCT value FROM (SELECT unnest(string_split(raw_text, chr(10))) AS value FROM extracted) WHERE {trim('value')} <> ''",
    "first_links": f"SELECT url_key FROM (SELECT {URL} AS url_key, row_number() OVER (PARTITION BY coalesce({DRIVE}, {URL}) ORDER BY length(slug)) AS n FROM sources WHERE url IS NOT NULL) WHERE n = 1",
    "protected_formulas": f"SELECT rid, len(regexp_extract_all(coalesce(soal, ''), {q(FORMULAS)}))::int AS n_formulas, length(regexp_replace(coalesce(soal, ''), {q(FORMULAS)}, '', 'g')) - length(replace(regexp_replace(coalesce(soal, ''), {q(FORMULAS)}, '', 'g'), '$', '')) AS signs_left, 1 AS same FROM gold",
    "extraction_metrics": r"SELECT doc_id, length(t) AS chars, len(regexp_extract_all(t, '\(cid:\d+\)'))::int AS cid, len(regexp_extract_all(t, '[√∫∑∏≤≥≠±∞→∂∆πθλµ²³¼½¾⁄∈∉⊂∪∩]'))::int AS mathsym, len(regexp_extract_all(t, '\$[^$]+\$|\\frac|\\sqrt|\\int|\\sum'))::int AS latex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "markdown_verdicts": f"SELECT NOT ({BAD_PAGE}) AS good, count(*) AS n_rows FROM (SELECT coalesce(text, '') AS t FROM documents) GROUP BY 1",
    "markdown_order": rf"""SELECT doc_id FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) ORDER BY (NOT ({BAD_PAGE}))::int, len(regexp_extract_all(t, '\(cid:\d+\)')) / greatest(length(t), 1) DESC, len(regexp_extract_all(t, '\p{{L}}')) / greatest(length(t), 1), doc_id LIMIT 20""",
    "attached_images": f"""SELECT ext_id, CASE WHEN regexp_matches(coalesce(raw_text, ''), {q(MENTIONS)}) OR n = 1 THEN coalesce(len(image_files), 0) ELSE 0 END::int AS n_images FROM (SELECT *, count(*) OVER (PARTITION BY source_file, source_page) AS n FROM extracted WHERE source_file IS NOT NULL AND source_page IS NOT NULL)""",
    "field_tasks": "SELECT field, count(*) AS n_rows, sum(length(text))::bigint AS chars FROM (UNPIVOT (SELECT rid, soal, cara, jawaban FROM gold) ON soal, cara, jawaban INTO NAME field VALUE text) WHERE length(text) >= 5 GROUP BY field",
    "translated_once": r"SELECT rid, CASE WHEN regexp_matches(soal, '\p{L}') THEN lower(soal) ELSE soal END AS translated FROM gold",
    "text_layers": f"""WITH p AS (SELECT source_file, raw_text, row_number() OVER (PARTITION BY source_file ORDER BY ext_id) - 1 AS page, count(*) OVER (PARTITION BY source_file) AS n FROM extracted WHERE source_file IS NOT NULL),
        s AS (SELECT * FROM p WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: (i * n) // 20 + CASE WHEN (i * n) % 20 > 0 THEN 1 ELSE 0 END), page)) SELECT source_file, round(avg((length({trim('raw_text')}) >= 40)::int), 4) AS ratio, avg((length({trim('raw_text')}) >= 40)::int) >= 0.5 AS is_text FROM s GROUP BY 1""",
    "page_routes": f"SELECT {ROUTE} AS route, count(*) AS n_rows FROM extracted GROUP BY 1",
    "page_payloads": f"SELECT {ROUTE} AS route, count(*) AS n_rows, sum(strlen(raw_text))::bigint AS payload_bytes FROM extracted GROUP BY 1",
    "continued_items": f"""WITH r AS (SELECT source_file, ext_id, sum(regexp_matches({trim('question')}, '[.?!:;]$')::int) OVER (PARTITION BY source_file ORDER BY ext_id) AS g FROM extracted)
        SELECT source_file, min(ext_id) AS ext_id, count(*)::int AS parts FROM r WHERE g > 0 GROUP BY source_file, g""",
    "text_keys": f"SELECT rid, sha1({key('soal')}) AS hash FROM gold",
    "clean_texts": rf"""SELECT ext_id, {trim(chain("coalesce(raw_text, '')", (chr(13), chr(10)), ('[ ' + chr(9) + ']+', ' '), (chr(10) + '{3,}', chr(10) + chr(10))))} AS page, CASE WHEN {trim('image_text')} = '' THEN raw_text ELSE {trim('raw_text')} || chr(10) || chr(10) || '[Deskripsi Gambar]' || chr(10) || {trim('image_text')} END AS described FROM extracted""",
    "solution_texts": rf"""SELECT corr_id, {trim("CASE WHEN contains(text, '</think>') THEN substr(text, strpos(text, '</think>') + 8) ELSE text END")} AS behind, {trim(chain("coalesce(text, '')", ('(?i)</?think>', ''), (chr(10) + '{3,}', chr(10) + chr(10))))} AS body FROM correct""",
    "rendered_chats": "SELECT chat_id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>'), chr(10)) AS rendered FROM chatml",
    "file_names": rf"""SELECT slug, substr(regexp_replace(regexp_replace(regexp_replace({trim('coalesce(filename, slug)')}, '[^\w\s.-]', '', 'g'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20) || '.pdf' AS safe,
        CASE WHEN contains(lower(coalesce(filename, '')), 'nocot') OR contains(lower(coalesce(filename, '')), 'no_cot') THEN 'nocot' WHEN contains(lower(coalesce(filename, '')), 'cot') THEN 'cot' ELSE 'auto' END AS mode,
        CASE WHEN starts_with(replace(coalesce(url, ''), '\', '/'), 'https://contoh.id/') THEN substr(replace(coalesce(url, ''), '\', '/'), 19) ELSE replace(coalesce(url, ''), '\', '/') END AS relative FROM sources""",
    "page_flags": rf"""WITH t AS (SELECT jenis, source, coalesce(text, '') AS t FROM documents) SELECT jenis, count(*) AS n_rows, sum((coalesce(source, '') = 'web_01' OR length({trim('t')}) < 40 OR regexp_matches(t, '(?i)\b(soal|jawaban|pembahasan|tentukan|hitung|buktikan|berapa)\b') OR regexp_matches(t, '(?m)^\s*\d{{1,3}}[.)]\s'))::int)::bigint AS marked,
        sum((contains(upper(t), 'VALID') AND NOT contains(upper(t), 'TIDAK_VALID') AND NOT contains(upper(t), 'TIDAK VALID'))::int)::bigint AS verdict, sum(regexp_matches(t, '\p{{L}}')::int)::bigint AS letters,
        sum((regexp_matches(regexp_replace(t, '\[Gambar:[^\]]*\]', '', 'g'), {q(IMAGES)}) AND len(list_filter(regexp_extract_all(t, '\[Gambar:([^\]]*)\]', 1), lambda x: length(trim(x)) >= 25)) = 0)::int)::bigint AS described FROM t GROUP BY jenis""",
    "chat_questions": f"SELECT chat_id, {trim(f'CASE WHEN starts_with({ASKED}, {q(COT)} || chr(10) || chr(10)) THEN substr({ASKED}, length({q(COT)}) + 3) ELSE {ASKED} END')} AS question FROM chatml",
    "training_pairs": f"""WITH held AS (SELECT {key('soal')} AS k FROM gold WHERE split <> 'train_pool'), b AS (SELECT *, {boxed('text', '[^{]*', True)} AS box FROM correct), o AS (SELECT *, row_number() OVER (PARTITION BY {key('soal')} ORDER BY corr_id) AS n FROM b WHERE box IS NOT NULL AND {key('soal')} NOT IN (SELECT k FROM held)),
        s AS (SELECT id, candidate_idx, box, {trim(chain("coalesce(text, '')", ('(?i)</?think>', ''), (chr(10) + '{3,}', chr(10) + chr(10))))} AS body FROM o WHERE n = 1)
        SELECT id, candidate_idx, 'cot' AS arm, body AS reply FROM s UNION ALL SELECT id, candidate_idx, 'nocot', '\\boxed{{' || box || '}}' FROM s""",
}
