"""DuckDB SQL of the core queries. The patterns are the library's; what RE2 lacks is written another way."""

from __future__ import annotations

from lintang.functions import predicates as P
from lintang.functions.text import LEVELS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), {q(pattern)})"


def count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), {q(pattern)}))"


def trim(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^\\s+|\\s+$', '', 'g')"


def squeeze(column: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g')))"


def chain(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"
    return expr


def balanced(depth: int = 12) -> str:
    pattern = r"[^{}]*"
    for _ in range(depth):
        pattern = rf"[^{{}}]*(?:\{{{pattern}\}}[^{{}}]*)*"
    return pattern


def boxed(column: str, lead: str = r"\s*", stripped: bool = False) -> str:
    after = f"split_part({column}, '\\boxed', -1)"
    body = f"regexp_extract({after}, {q(rf'(?s)^{lead}' + chr(92) + '{(' + balanced(5) + ')' + chr(92) + '}')}, 1)"
    body = trim(body) if stripped else body
    test = f"regexp_matches({after}, {q(rf'(?s)^{lead}' + chr(92) + '{' + balanced(5) + chr(92) + '}')})"
    return f"CASE WHEN contains({column}, '\\boxed') AND {test} THEN {body} END"


def last_number(column: str) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), {q(r'-?\d+(?:[.,]\d+)?')})[-1]"


def normal(column: str) -> str:
    thousands, decimal = (r"(\d),(\d{3})\b", r"\1\2"), (r"(\d),(\d)", r"\1.\2")
    return "lower(" + chain(
        trim(column), (r"\\[()\[\]]", ""), (r"\$", ""), (r"\\[dt]frac", r"\\frac"), (r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)"), (r"^\s+|\s+$", ""),
        (r"\\(?:text|mathrm|mbox|operatorname)\s*\{([^{}]*)\}", r"\1"), (r"\\(?:left|right|,|;|!|quad|qquad)", ""), (r"^\s*[A-Ea-e][.)]\s+(\S)", r"\1"),
        (r"^[A-Za-z]'?\s*=\s*", ""), (r"\\(?:cdot|times)", "*"), (r"\\%", "%"), (r"\((-?\d+(?:\.\d+)?)\)", r"\1"), (" ", ""),
        thousands, thousands, thousands, decimal, decimal, (r"\.+$", ""),
    ) + ")"


def loose(column: str) -> str:
    t = trim(column)
    inner = chain(
        f"coalesce({boxed(t, '[^{]*', True)}, {t})", (r"^\s+|\s+$", ""), (r"^\$+|\$+$", ""), (r"^\s+|\s+$", ""), (r"\\[!,;]", ""), (r"\\ ", " "),
        (r"\\(?:left|right)", ""), (r"\\[dt]frac", r"\\frac"), (r"\{,\}", "."), (r"\.+$", ""), (r"\s+", ""),
    )
    return f"lower(CASE WHEN regexp_matches({inner}, '^-?\\d+,\\d+$') THEN replace({inner}, ',', '.') ELSE {inner} END)"


def number(expr: str) -> str:
    bare = f"regexp_replace(trim({expr}), '%+$', '')"
    frac = f"try_cast(regexp_extract({bare}, '^([-+]?\\d+)/(\\d+)$', 1) AS double) / nullif(try_cast(regexp_extract({bare}, '^([-+]?\\d+)/(\\d+)$', 2) AS double), 0)"
    unit = f"replace(regexp_extract({bare}, {q(r'^\s*(-?\d+(?:[.,]\d+)?)\s*[a-zA-Z%°]*\s*$')}, 1), ',', '.')"
    plain = f"regexp_matches({bare}, {q(r'(?i)^\s*[-+]?(\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?\s*$')})"
    return f"CASE WHEN regexp_matches({bare}, '^[-+]?\\d+/\\d+$') THEN {frac} WHEN {plain} THEN try_cast(trim({bare}) AS double) WHEN {unit} <> '' THEN try_cast({unit} AS double) END"


def graded(source: str, pred: str, gold: str) -> str:
    """CTEs that end in ``graded`` with pn, gn, x, y, pred and correct."""
    return f"""
    g0 AS (SELECT *, {pred} AS pred FROM {source}),
    g1 AS (SELECT *, {normal('pred')} AS pn, {normal(gold)} AS gn FROM g0),
    g2 AS (SELECT *, {number('pn')} AS x, {number('gn')} AS y FROM g1),
    graded AS (SELECT *, pred IS NOT NULL AND gn <> '' AND (pn = gn OR coalesce(abs(x - y) <= 1e-6 * greatest(1.0, abs(y)), false)) AS correct FROM g2)"""


ANSWER = f"coalesce({boxed('text')}, {last_number('text')})"
INDONESIAN = f"{count('{c}', P.INDONESIAN_CUES)} >= {count('{c}', P.ENGLISH_CUES)}"


def indonesian(column: str) -> str:
    return f"({count(column, P.INDONESIAN_CUES)} >= {count(column, P.ENGLISH_CUES)})"


def numeric_gold(column: str) -> str:
    bare = chain(f"coalesce({column}, '')", (P.UNIT_WORDS, ""), (r"^\.+|\.+$", ""), (r"^\$+|\$+$", ""))
    return f"regexp_matches({bare}, '^-?\\d+([.,]\\d+)?$')"


def shape(column: str) -> str:
    s, n = trim(column), normal(column)
    words = chain(s, (r"\\(?:text|mathrm|boxed)\s*\{[^{}]*\}", ""))
    return (
        f"CASE WHEN {s} = '' THEN 'empty' WHEN regexp_matches({n}, '^-?\\d+(?:\\.\\d+)?$') THEN 'numeric' WHEN regexp_matches({n}, '^-?\\d+/\\d+$') THEN 'fraction' "
        f"WHEN contains({s}, ' ') AND regexp_matches({words}, '[A-Za-z]{{4,}}') THEN 'text' ELSE 'expr' END"
    )


def flag_sums(**columns: str) -> str:
    return ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::bigint AS {name}" for name, c in columns.items())


def even(column: str, a: str, b: str) -> str:
    n = lambda t: f"(length({column}) - length(replace({column}, {q(t)}, ''))) // {len(t)}"
    return f"{n(a)} = {n(b)}"


BALANCED = " AND ".join([even("coalesce(soal,'')", r"\(", r"\)"), even("coalesce(soal,'')", r"\[", r"\]"), even("coalesce(soal,'')", "{", "}"), "(length(coalesce(soal,'')) - length(replace(coalesce(soal,''), '$', ''))) % 2 = 0"])
MC, MCS = f"{count('soal', P.CHOICE_LOOSE)} >= 3", f"{count('soal', P.CHOICE_STRICT)} >= 3"
VALID = f"length({trim('soal')}) BETWEEN 30 AND 1500 AND ({has(trim('soal'), P.PROBLEM_KEYWORDS)} OR {has(trim('soal'), P.MATH_SIGNS)})"
SCHOOL = f"{trim('jawaban')} <> '' AND NOT regexp_matches({trim('jawaban')}, '^[A-E]\\.?$') AND NOT {has('soal', P.NEEDS_VISUAL)} AND {numeric_gold('jawaban')} AND length(coalesce(soal,'')) > 20 AND length(coalesce(soal,'')) < 600"
RULES = {
    1: [(MC, "multiple_choice"), (has("soal", P.TRUE_FALSE_LOOSE), "true_false"), (has("soal", P.IMAGE_SHORT), "needs_image"), (f"NOT {indonesian('soal')}", "not_indonesian")],
    2: [(f"length({trim('soal')}) < 10", "too_short"), (MCS, "multiple_choice"), (has("soal", P.TRUE_FALSE_STRICT), "true_false"), (has("soal", P.IMAGE_LONG), "needs_image"), (f"NOT {indonesian('soal')}", "not_indonesian")],
    3: [(f"length({trim('soal')}) < 10", "too_short"), (MCS, "multiple_choice"), (has("soal", P.TRUE_FALSE_STRICT), "true_false")],
}


def reason(version: int) -> str:
    cases = " ".join(f"WHEN {c} THEN {q(name)}" for c, name in RULES[version])
    return f"SELECT split, CASE {cases} ELSE 'passed' END AS reason, count(*) AS rows, {version}::int AS version FROM gold GROUP BY 1, 2"


KEPT = f"""c AS (SELECT DISTINCT id, candidate_idx, soal, jawaban, source, text FROM candidate WHERE id IS NOT NULL AND candidate_idx IS NOT NULL),
    p AS (SELECT *, {boxed('text', '[^{]*', True)} AS pred FROM c),
    s AS (SELECT *, CASE WHEN pred IS NULL THEN 'no_boxed' WHEN {trim('jawaban')} = '' THEN 'no_gold' WHEN {loose('pred')} = {loose('jawaban')} AND {loose('pred')} <> '' THEN 'kept' ELSE 'wrong' END AS status FROM p)"""
STEPS = f"coalesce({boxed('cara')}, regexp_extract_all(coalesce(cara, ''), '\\$([^$]+)\\$', 1)[-1], {last_number('cara')})"
GARBLED = P.GARBLED
LAST = "list_filter(messages, lambda m: m.role = '{r}')[-1].content"


def last(role: str) -> str:
    return f"coalesce({LAST.format(r=role)}, '')"


def unwrap(column: str) -> str:
    return trim(f"CASE WHEN contains({column}, chr(10) || chr(10)) THEN substr({column}, strpos({column}, chr(10) || chr(10)) + 2) ELSE {column} END")


def level(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(coalesce({column}, '')), {q(a)}) THEN {q(b)}" for a, b in LEVELS) + " ELSE 'unknown' END"


def garbled(*columns: str) -> str:
    return "(" + " OR ".join(has(c, GARBLED) for c in columns) + ")"


def pass_k(k: int) -> str:
    size = f"least({k}, n)"
    product = " * ".join(f"(CASE WHEN {i} < {size} THEN (n - c - {i})::double / greatest(n - {i}, 1) ELSE 1 END)" for i in range(k))
    return f"CASE WHEN c <= 0 THEN 0.0 WHEN n - c < {size} THEN 1.0 ELSE 1.0 - {product} END"


def majority(k: int) -> str:
    return f"""v{k} AS (SELECT source, id, pn, count(*) AS votes, min(candidate_idx) AS seen, bool_or(correct) AS ok FROM ranked WHERE rn <= {k} AND coalesce(pred, '') <> '' GROUP BY 1, 2, 3),
    m{k} AS (SELECT source, id, arg_max(ok, votes * 1000 - seen)::int AS maj FROM v{k} GROUP BY 1, 2)"""


ORACLE = {
    "question_flags": "SELECT split, count(*) AS n_rows, " + flag_sums(
        choice_loose=MC, choice_strict=MCS, true_false_loose=has("soal", P.TRUE_FALSE_LOOSE), true_false_strict=has("soal", P.TRUE_FALSE_STRICT),
        image_short=has("soal", P.IMAGE_SHORT), image_long=has("soal", P.IMAGE_LONG), image_hint=has("soal", P.IMAGE_HINT), outside_context=has("soal", P.EXTERNAL_CONTEXT),
        valid_problem=VALID, latex_balanced=BALANCED, hard_topic=has("soal", P.HARD_TOPICS), complete=f"regexp_matches({trim('soal')}, '[.?!:;]$')", indonesian=indonesian("soal"),
        numeric_gold=numeric_gold("jawaban"), school_item=SCHOOL, needs_fill=f"{trim('jawaban')} = '' OR {trim('cara')} = ''", usable=f"{trim('soal')} <> '' OR {trim('jawaban')} <> ''",
    ) + " FROM gold GROUP BY split",
    "rule_reasons": " UNION ALL ".join(reason(v) for v in (1, 2, 3)),
    "answer_shapes": "SELECT split, " + ", ".join(f"count(*) FILTER (s = '{n}') AS {n}" for n in ("empty", "numeric", "fraction", "text", "expr")) + f" FROM (SELECT split, {shape('jawaban')} AS s FROM gold) GROUP BY split",
    "answer_types": f"""SELECT split, CASE WHEN j = '' THEN 'empty' WHEN regexp_matches(core, '^-?\\d+$') THEN 'pure_int' WHEN regexp_matches(core, '^-?\\d+([./]\\d+)?$') THEN 'pure_num'
        WHEN len(regexp_extract_all(j, '[A-Za-z]{{3,}}')) <= 1 THEN 'single_expr' WHEN contains(j, '$') OR contains(j, '\\') THEN 'sentence' ELSE 'sentence_plain' END AS kind, count(*) AS n_rows
        FROM (SELECT split, j, {chain('j', (chr(94) + chr(92) + '.+|' + chr(92) + '.+$', ''), (r'^\$+|\$+$', ''), (r'^\s+|\s+$', ''))} AS core FROM (SELECT split, {trim('jawaban')} AS j FROM gold)) GROUP BY 1, 2""",
    "most_complete": f"""SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY {trim('soal')} ORDER BY ({trim('jawaban')} <> '') DESC, ({trim('cara')} <> '') DESC, length({trim('cara')}) DESC, rid) AS n
        FROM gold WHERE {trim('soal')} <> '') WHERE n = 1""",
    "exact_rows": f"SELECT DISTINCT {trim('soal')} AS soal, {trim('cara')} AS cara, {trim('jawaban')} AS jawaban FROM gold",
    "duplicate_counts": f"SELECT count(k) AS rows, count(DISTINCT k) AS distinct_keys, count(k) - count(DISTINCT k) AS duplicates FROM (SELECT {squeeze('soal')} AS k FROM gold)",
    "candidates_distinct": "SELECT DISTINCT id, candidate_idx FROM candidate WHERE id IS NOT NULL AND candidate_idx IS NOT NULL",
    "rejection_sampling_stats": f"WITH {KEPT} SELECT source, count(*) AS total, count(*) FILTER (status = 'no_boxed') AS no_boxed, count(*) FILTER (status = 'no_gold') AS no_gold, count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (status = 'kept') AS kept, count(DISTINCT id) FILTER (status = 'kept') AS problems_covered FROM s GROUP BY source",
    "resumed_candidates": "SELECT candidate_idx, count(*) AS n_rows, count(DISTINCT id) AS problems FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM correct x WHERE x.id = c.id AND x.candidate_idx = c.candidate_idx) GROUP BY 1",
    "missing_candidates": """WITH h AS (SELECT id, count(*) AS have FROM (SELECT DISTINCT id, candidate_idx FROM candidate) GROUP BY id), p AS (SELECT DISTINCT 'q' || lpad(rid::varchar, 9, '0') AS id FROM gold)
        SELECT id, unnest(range(coalesce(have, 0), 4))::int AS candidate_idx FROM p LEFT JOIN h USING (id) WHERE coalesce(have, 0) < 4""",
    "graded_candidates": f"WITH {graded('candidate', ANSWER, 'jawaban')} SELECT source, count(*) AS n_rows, sum(correct::int)::bigint AS correct, sum((({boxed('text')}) IS NOT NULL)::int)::bigint AS boxed FROM graded GROUP BY source",
    "sampled_scores": f"""WITH d AS (SELECT DISTINCT id, candidate_idx, jawaban, source, text FROM candidate WHERE id IS NOT NULL AND candidate_idx IS NOT NULL), {graded('d', ANSWER, 'jawaban')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY candidate_idx) AS rn, ({boxed('text')}) IS NOT NULL AS hb FROM graded), {majority(3)}, {majority(5)},
        per AS (SELECT source, id, count(*) AS n, sum(correct::int) AS c, sum(hb::int) AS boxed FROM ranked GROUP BY 1, 2)
        SELECT per.source, count(*) AS problems, sum(n)::bigint AS samples, {', '.join(f'round(avg({pass_k(k)}), 4) AS pass_{k}' for k in (1, 2, 3))}, round(avg(coalesce(m3.maj, 0)), 4) AS maj_3, round(avg(coalesce(m5.maj, 0)), 4) AS maj_5,
        round(sum(boxed) / sum(n), 4) AS format_ok_rate FROM per LEFT JOIN m3 ON m3.id = per.id AND m3.source IS NOT DISTINCT FROM per.source LEFT JOIN m5 ON m5.id = per.id AND m5.source IS NOT DISTINCT FROM per.source GROUP BY per.source""",
    "teacher_scores": """WITH a AS (SELECT source, count(*) AS candidate_rows, count(DISTINCT id) AS problems_tried FROM candidate GROUP BY source),
        b AS (SELECT s.source, count(*) AS correct_rows, count(DISTINCT c.id) AS problems_solved FROM correct c JOIN (SELECT DISTINCT id, source FROM candidate) s ON s.id = c.id GROUP BY s.source),
        r AS (SELECT a.source, candidate_rows, problems_tried, coalesce(correct_rows, 0) AS correct_rows, coalesce(problems_solved, 0) AS problems_solved FROM a LEFT JOIN b ON a.source = b.source),
        p AS (SELECT *, round(100.0 * correct_rows / candidate_rows, 2)::double AS retention_pct, round(100.0 * problems_solved / problems_tried, 2)::double AS coverage_pct FROM r)
        SELECT *, source = (SELECT source FROM p WHERE source IS NOT NULL ORDER BY retention_pct DESC, coverage_pct DESC, source DESC LIMIT 1) AS winner FROM p""",
    "best_solutions": f"""SELECT id, candidate_idx FROM (SELECT id, candidate_idx, row_number() OVER (PARTITION BY id ORDER BY NOT {indonesian('body')}, length(body), candidate_idx) AS n FROM
        (SELECT id, candidate_idx, {trim(chain("coalesce(text, '')", ('(?i)</?think>', ''), (chr(10) + '{3,}', chr(10) + chr(10))))} AS body FROM correct WHERE ({boxed('text', '[^{]*', True)}) IS NOT NULL)) WHERE n = 1""",
    "sft_statistics": f"""SELECT with_steps, count(*) AS n_rows, median(n)::double AS median_chars, max(n) AS most_chars FROM (SELECT s <> '' AND length(s) <= 1200 AS with_steps,
        CASE WHEN s <> '' AND length(s) <= 1200 THEN length(s) + 2 ELSE 0 END + length(j) + 8 AS n FROM (SELECT {trim('cara')} AS s, {trim('jawaban')} AS j FROM gold) WHERE j <> '') GROUP BY 1""",
    "decontaminated_chat": f"""SELECT chat_id FROM chatml WHERE {squeeze("trim(regexp_replace(" + unwrap(last('user')) + ", '^Soal:', ''))")} NOT IN (SELECT {squeeze('soal')} FROM gold WHERE split <> 'train_pool')""",
    "provenance_tags": f"""WITH t AS (SELECT {trim('soal')} AS k, source FROM gold) SELECT CASE WHEN k IN (SELECT k FROM t WHERE source LIKE 'osn%') THEN 'AIMO' WHEN k IN (SELECT k FROM t WHERE starts_with(source, 'un_')) THEN 'UN'
        WHEN k IN (SELECT k FROM t WHERE source LIKE 'paket%') THEN 'AIMO' ELSE 'unknown' END AS tag, count(*) AS n_rows FROM t GROUP BY 1""",
    "cache_overlay": f"SELECT {trim('soal')} IN (SELECT {trim('soal')} FROM candidate WHERE contains(text, 'boxed')) AS filled, count(*) AS n_rows FROM gold GROUP BY 1",
    "cross_arm": f"""WITH t AS (SELECT chat_id, arm, {squeeze(unwrap(last('user')))} AS k, {normal('(' + boxed(last('assistant')) + ')')} AS a FROM chatml),
        w AS (SELECT arm, k, arg_max(a, chat_id) AS a FROM t GROUP BY 1, 2) SELECT count(*) AS pairs, sum((x.a = y.a)::int)::bigint AS same FROM w x JOIN w y ON x.k = y.k WHERE x.arm = 'cot' AND y.arm = 'nocot'""",
    "pool_intersection": "SELECT id FROM candidate WHERE id IS NOT NULL INTERSECT SELECT id FROM correct INTERSECT SELECT id FROM progress",
    "cleaning_reasons": f"""WITH {graded('gold', STEPS, 'jawaban')} SELECT split, CASE WHEN {trim('jawaban')} = '' THEN 'jawaban_kosong' WHEN length({trim('soal')}) < 20 THEN 'soal_rusak' WHEN {garbled('soal', 'jawaban', 'cara')} THEN 'mojibake'
        WHEN {has(trim('soal'), P.EXTERNAL_CONTEXT)} THEN 'butuh_konteks_luar' WHEN coalesce(cara, '') <> '' AND pred IS NOT NULL AND NOT correct THEN 'cara_vs_gold_mismatch' WHEN {shape('jawaban')} = 'text' THEN 'jawaban_teks_bebas' ELSE 'passed' END AS reason, count(*) AS rows FROM graded GROUP BY 1, 2""",
    "inspection": f"""SELECT split, count(*) AS rows, {flag_sums(empty_question=f"{trim('soal')} = ''", empty_answer=f"{trim('jawaban')} = ''", garbled=garbled('soal', 'jawaban'), outside_context=has('soal', P.EXTERNAL_CONTEXT))},
        count(*) - count(DISTINCT {squeeze('soal')}) AS duplicates, {', '.join(f"count(*) FILTER (({shape('jawaban')}) = '{s}') AS shape_{s}" for s in ('empty', 'numeric', 'fraction', 'text', 'expr'))} FROM gold GROUP BY split""",
    "chat_inspection": f"""WITH t AS (SELECT arm, {last('assistant')} AS said, {last('user')} AS asked FROM chatml) SELECT arm, count(*) AS rows, {flag_sums(empty_reply=f"{trim('said')} = ''", empty_prompt=f"{trim('asked')} = ''", no_box=f"({boxed('said')}) IS NULL", garbled=garbled('said'), very_long="length(said) > 2500")} FROM t GROUP BY arm""",
    "valid_chat": f"""SELECT split, count(*) AS n_rows, sum(coalesce(len(messages) >= 2 AND len(list_filter(messages, lambda m: m.role = 'user')) > 0 AND len(list_filter(messages, lambda m: m.role = 'assistant' AND {trim('m.content')} <> '')) > 0, false)::int)::bigint AS valid FROM chatml GROUP BY split""",
    "answer_distribution": f"""WITH c AS (SELECT split, {trim('jawaban')} AS a, count(*) AS c FROM gold WHERE {trim('jawaban')} <> '' GROUP BY 1, 2), s AS (SELECT split, sum(c)::bigint AS n, count(*) AS distinct_answers, max(c) AS top, sum(c * log2(c)) AS t FROM c GROUP BY 1)
        SELECT split, n, distinct_answers, round(CASE WHEN distinct_answers < 2 THEN 0.0 ELSE (log2(n) - t / n) / log2(distinct_answers) END, 3) AS entropy, round(top / n, 3) AS top_share FROM s""",
    "length_outliers": """WITH s AS (SELECT split, length(soal) AS len FROM gold WHERE length(soal) > 0), c AS (SELECT split, median(len) AS med FROM s GROUP BY 1), a AS (SELECT s.split, abs(len - med) AS d FROM s JOIN c ON s.split = c.split),
        m AS (SELECT split, median(d) AS mad, avg(d) AS mean_ad FROM a GROUP BY 1) SELECT a.split, count(*) AS n, CASE WHEN count(*) < 3 THEN 0.0 ELSE round(avg((CASE WHEN mad > 0 THEN 0.6745 * d / mad WHEN mean_ad > 0 THEN d / (1.253314 * mean_ad) ELSE 0 END > 3.5)::int), 3) END AS outlier_rate FROM a JOIN m ON a.split = m.split GROUP BY 1""",
    "clipped_lengths": "SELECT (least(length(coalesce(soal, '')), 800) // 50 * 50)::int AS bucket, count(*) AS n_rows FROM gold GROUP BY 1",
    "funnel": "WITH t AS (SELECT 0 AS step, 'candidate' AS stage, count(DISTINCT id) AS problems FROM candidate UNION ALL SELECT 1, 'progress', count(DISTINCT id) FROM progress UNION ALL SELECT 2, 'correct', count(DISTINCT id) FROM correct) SELECT *, round(problems / (SELECT problems FROM t WHERE step = 0), 4) AS share FROM t",
    "source_yield": "WITH k AS (SELECT id, count(*) AS k FROM correct GROUP BY 1), m AS (SELECT source, id, count(*) AS m FROM candidate GROUP BY 1, 2) SELECT source, sum(m)::bigint AS candidates, coalesce(sum(k), 0)::bigint AS kept, round(coalesce(sum(k), 0) / sum(m), 3) AS share FROM m LEFT JOIN k ON m.id = k.id GROUP BY 1",
    "source_status": "SELECT CASE WHEN starts_with(status, 'dedup') THEN 'dedup' WHEN status IN ('ok', 'no_links', 'partial') THEN 'ok' ELSE status END AS state, count(*) AS n_rows FROM sources GROUP BY 1",
    "source_fields": f"""SELECT slug, regexp_replace(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substr(trim(url), length(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1), '/+$', '') AS url_key,
        coalesce(nullif(regexp_extract(url, 'drive\\.google\\.com/file/d/([^/?#]+)', 1), ''), nullif(regexp_extract(url, 'drive\\.google\\.com/open\\?id=([^&]+)', 1), ''), nullif(regexp_extract(url, 'drive\\.google\\.com/uc\\?.*?id=([^&]+)', 1), '')) AS drive,
        {level('slug')} AS level_name, coalesce(nullif(regexp_extract(coalesce(note, ''), '\\b(20\\d{{2}})\\b', 1), ''), 'unknown') AS year,
        coalesce(nullif(regexp_replace(regexp_replace(coalesce(filename, ''), '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x') AS file_slug FROM sources""",
    "document_inventory": "SELECT source_file, count(*) AS pages, sum(source_page)::bigint AS page_sum, sum(coalesce(has_image, false)::int)::bigint AS with_image FROM extracted GROUP BY 1",
    "carried_method": "SELECT ext_id, last_value(CASE WHEN has_image THEN extraction_method END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY ext_id) AS carried FROM extracted",
    "message_roles": "SELECT arm, m.role AS role, count(*) AS n_rows, sum(length(m.content))::bigint AS chars FROM (SELECT arm, unnest(messages) AS m FROM chatml) GROUP BY 1, 2",
    "embedding_decontamination": "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS v FROM embeddings) SELECT a.vec_id FROM u a, u b WHERE a.label <> 0 AND b.label = 0 GROUP BY 1 HAVING max(list_dot_product(a.v, b.v)) < 0.4",
    "jsonl_roundtrip": "SELECT soal, cara, jawaban, source, answer_type, hard::int AS hard FROM gold",
    "streamed_sampling": f"WITH {KEPT} SELECT status, count(*) AS rows FROM s GROUP BY status",
}
