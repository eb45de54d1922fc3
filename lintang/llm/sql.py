"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

# Texts that merely say that a value is missing, without letter case, white space and end marks.
MISSING = (
    "n/a", "n.a", "na", "null", "none", "nan", "nil", "tba", "tbd", "xxx", "xx", "x", "kosong", "(kosong)", "[kosong]", "tidakada", "belumada", "tidaktersedia", "belumtersedia",
    "belumdiisi", "tidakdiketahui", "unknown", "missing", "empty", "(empty)", "notavailable", "todo", "undefined",
)
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
QUESTION = "list_filter(messages, lambda m: m.role = 'user')[1].content"


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def squeezed(text: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{SPACE}', '{to}', 'g')"


def _survivors() -> str:
    missing = ", ".join(f"'{m}'" for m in MISSING)
    bare = f"lower({squeezed('value')})"
    usable = (
        f"value IS NOT NULL AND {squeezed('value')} <> '' AND {bare} NOT IN ({missing}) AND regexp_replace({bare}, '[.!]+$', '') NOT IN ({missing}) "
        rf"AND NOT regexp_matches({bare}, '^[-–—_.…?*/~()\[\]]+$')"
    )
    key = rf"regexp_replace(lower(soal), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}$.,;:!?]+|\\\(|\\\)', '', 'g')"
    norm = f"regexp_replace({squeezed('value', ' ')}, '^[ .…]+|[ .…]+$', '', 'g')"
    return f"""
    WITH rows AS (SELECT rid, {key} AS k, soal, cara, jawaban, scraped_at, coalesce(t.trust, 0) AS trust
        FROM gold LEFT JOIN (SELECT slug, max(trust) AS trust FROM sources GROUP BY slug) t ON t.slug = gold.source WHERE soal IS NOT NULL AND {squeezed('soal')} <> ''),
    grouped AS (SELECT *, min(rid) OVER (PARTITION BY k) AS group_rid, count(*) OVER (PARTITION BY k) AS n FROM rows),
    long AS (SELECT group_rid, rid, trust, scraped_at, unnest([{{'field': 'soal', 'value': soal}}, {{'field': 'cara', 'value': cara}}, {{'field': 'jawaban', 'value': jawaban}}], recursive := true) FROM grouped WHERE n > 1),
    usable AS (SELECT *, {norm} AS norm FROM long WHERE {usable}),
    whole AS (SELECT * FROM usable u WHERE field <> 'cara' OR NOT EXISTS (SELECT 1 FROM usable v WHERE v.group_rid = u.group_rid AND v.field = 'cara' AND v.norm <> u.norm AND starts_with(v.norm, u.norm)))
    SELECT group_rid, field, rid AS from_rid, value FROM (SELECT *, row_number() OVER (PARTITION BY group_rid, field ORDER BY trust DESC, scraped_at DESC NULLS LAST, rid) AS place FROM whole) WHERE place = 1"""


def _sets(name: str, source: str, row_id: str, text: str) -> str:
    return f"{name} AS (SELECT {row_id} AS id, len(w) AS n, unnest(w) AS x FROM (SELECT {row_id}, list_distinct({words(text)}) AS w FROM {source}) WHERE len(w) >= 12)"


_ENOUGH = "GROUP BY a.id, b.id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))"

_CLASSES = f"""WITH w AS (SELECT rid, list_sort(list_distinct({words('soal')})) AS s FROM gold), c AS (SELECT s, min(rid) AS rep, count(*) AS members FROM w WHERE len(s) >= 12 GROUP BY s),
    t AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c), p AS (SELECT a.rep AS a, b.rep AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))"""
_OVERLAPS = f"""WITH asked AS (SELECT chat_id, CASE WHEN contains(q, 'Soal:') THEN substr(q, strpos(q, 'Soal:') + 5) ELSE q END AS q FROM (SELECT chat_id, {QUESTION} AS q FROM chatml WHERE split = 'train')),
    held AS (SELECT rid, soal FROM gold WHERE split <> 'train_pool'), {_sets('g', 'held', 'rid', 'soal')}, {_sets('c', 'asked', 'chat_id', 'q')},
    found AS (SELECT a.id AS rid, b.id AS chat_id FROM g a JOIN c b ON a.x = b.x {_ENOUGH})"""

ORACLE: dict[str, str] = {
    "p2_found": f"SELECT group_rid, field, from_rid FROM ({_survivors()})",
    "p2_survivors": _survivors(),
    "p4_classes": f"{_CLASSES}, l AS (SELECT a, count(*) AS k FROM p GROUP BY a) SELECT rid, rep AS class_rid, members AS class_size, coalesce(k, 0) AS linked_classes FROM w JOIN c ON w.s = c.s LEFT JOIN l ON l.a = rep",
    "p4_links": f"{_CLASSES} SELECT a AS class_a, b AS class_b, round(similarity, 6) AS similarity FROM p WHERE a < b",
    "p5_report": f"{_OVERLAPS}, r AS (SELECT rid, count(*) AS pairs FROM found GROUP BY rid) SELECT split, source, count(*) AS rows, sum(pairs)::bigint AS pairs FROM r JOIN gold USING (rid) GROUP BY 1, 2",
    "p4_found": f"WITH {_sets('t', 'gold', 'rid', 'soal')} SELECT a.id AS rid_a, b.id AS rid_b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id {_ENOUGH}",
    "p5_found": f"{_OVERLAPS} SELECT rid, chat_id FROM found",
    "p8_found": f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
        dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS r FROM d WHERE len(w) >= 12),
        ir AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS r FROM i WHERE len(w) >= 12)
        SELECT DISTINCT item_id, doc_id FROM dr JOIN ir ON dr.r = ir.r""",
}
