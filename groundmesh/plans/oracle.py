"""DuckDB SQL for the registered queries that SQL can express, over the same tables.

The tables' pages are made to one pattern (title, h1, paragraphs of one article), so SQL can take them apart; other markup is put behind
them, or tested by hand-built cases. In ``answer_checks`` a context counts as larger than its compression by what SQL has of both: the
blocks without their reasons, references and trace, against the compression and an upper bound of its notes. ``compression_sizes`` is exact.
"""

from __future__ import annotations

from groundmesh.plans.tables import SYNTHETIC as CFG

TERMS = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ZERO = r"[\x{200B}-\x{200D}\x{FEFF}]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, chr(160), ' '), '{ZERO}', '', 'g'), '{SPACE}', ' ', 'g'))"


def slug(x: str, default: str = "unknown") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', '-', 'g'), '-'), ''), '{default}')"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TERMS}')"


def contains_any(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def stable(*parts: str) -> str:
    return f"substring(sha1({' || chr(124) || '.join(parts)}), 1, 32)"


def penalty(x: str) -> str:
    return "least(0.6::DOUBLE, " + " + ".join(f"CASE WHEN contains(lower({x}), '{p}') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END" for p in CFG.generic_phrases) + ")"


def query_terms(x: str) -> str:
    listed = ", ".join(f"'{t}'" for t in CFG.operational_terms)
    return f"list_filter(list_distinct({terms(x)}), lambda t: length(t) > 2 OR list_contains([{listed}], t))"


UUID = """lower(substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
  CASE substring(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
       WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12))"""
URL = "6ba7b8119dad11d180b400c04fd430c8"
TITLE = clean("array_to_string(list_slice(string_split(split_part(coalesce(text, ''), chr(10), 1), ' '), 1, 8), ' ')")
DOCS = f"""
d0 AS (SELECT source AS source_file, CAST(doc_id AS VARCHAR) AS section_id, coalesce(text, '') AS content, {TITLE} AS title FROM documents),
d AS (SELECT *, {stable("source_file", "section_id", "title", "content")} AS id, {slug("title")} AS concept_id, title || ' ' || content || ' ' AS whole,
      CASE WHEN {contains_any("lower(title || ' ' || content)", CFG.risk_terms)} THEN 'risk' WHEN {contains_any("lower(title || ' ' || content)", CFG.procedure_terms)} THEN 'procedure' ELSE 'concept' END AS type FROM d0)"""
IMAGES = f"""
i AS (SELECT {stable("'page'", "CAST(page_id AS VARCHAR)")} AS image_id, 'page ' || CAST(page_id % 50 AS VARCHAR) AS title, {slug("'page ' || CAST(page_id % 50 AS VARCHAR)")} AS concept_id, 'pages' AS source_file, url AS description, CAST(page_id AS VARCHAR) AS section_id FROM pages)"""

SHEET_SQL = {
    "FG & PWO": "SELECT n_nationkey AS o, 'Functional Group (FG)' AS k1, r_name AS v1, 'Primary Work Object (PWO)' AS k2, n_name AS v2, 'Dependency Links' AS k3, r_name || ', , ' || n_name || ' base' AS v3 FROM nation JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT p_partkey + 1000, 'Functional Group (FG)', p_brand, 'Primary Work Object (PWO)', p_name || '#' || p_partkey, 'Dependency Links', p_type || ', ' || p_brand || ',, size ' || p_size FROM part",
    "SWO": "SELECT s_suppkey AS o, 'PWO' AS k1, n_name AS v1, 'Secondary Work Object (SWO)' AS k2, s_name AS v2, NULL AS k3, NULL AS v3 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "Skills": "SELECT l_suppkey * 10000000 + l_partkey AS o, 'SWO' AS k1, s_name AS v1, 'Skill' AS k2, p_name || '#' || p_partkey AS v2, NULL AS k3, NULL AS v3 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
    "Tasks": "SELECT o_orderkey AS o, 'Skill' AS k1, c_name AS v1, 'Task' AS k2, 'order ' || o_orderkey AS v2, NULL AS k3, NULL AS v3 FROM orders JOIN customer ON o_custkey = c_custkey",
    "Control Point": "SELECT l_orderkey * 10 + l_linenumber AS o, 'Task' AS k1, 'order ' || l_orderkey AS v1, 'Control Point' AS k2, 'order ' || l_orderkey || ' line ' || l_linenumber AS v2, NULL AS k3, NULL AS v3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}
RELATION_TYPES = {"FG & PWO": "has_pwo", "SWO": "has_swo", "Skills": "has_skill", "Tasks": "has_task", "Control Point": "has_control_point"}


def edges(names: tuple[str, ...] = tuple(SHEET_SQL)) -> str:
    """CTEs rows_, e0 and e: the edges of the sheets."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS sheet_name, '{RELATION_TYPES[n]}' AS kind, row_number() OVER (ORDER BY o) + 1 AS row_number, {', '.join(f'{clean(v)} AS {v}' for v in ('v1', 'v2', 'v3'))}, k1, k2, k3 FROM ({SHEET_SQL[n]})" for n in names)
    cell = lambda n: f"CASE WHEN v{n} <> '' THEN k{n} || ': ' || v{n} END"
    return f"""
rows_ AS (SELECT *, substring(concat_ws(' | ', {cell(1)}, {cell(2)}, {cell(3)}), 1, 1000) AS evidence FROM ({rows})),
e0 AS (SELECT sheet_name, row_number, evidence, v1 AS source_label, v2 AS target_label, kind AS relation_type FROM rows_
       UNION ALL SELECT sheet_name, row_number, evidence, v2, part, 'depends_on' FROM (SELECT *, {clean("unnest(string_split(v3, ','))")} AS part FROM rows_ WHERE v3 IS NOT NULL) WHERE part <> ''),
e AS (SELECT *, {stable("'star.xlsx'", "sheet_name", "CAST(row_number AS VARCHAR)", "source_label", "target_label", "relation_type")} AS relation_id, {slug("source_label")} AS source_id, {slug("target_label")} AS target_id,
      {clean("source_label || ' ' || replace(relation_type, '_', ' ') || ' ' || target_label || '.'")} AS description FROM e0)"""


DOC_EDGES = f"""
x0 AS (SELECT 'Skills' AS sheet_name, CAST(section_id AS INTEGER) AS row_number, title AS source_label, {clean("'source ' || source_file")} AS target_label, 'has_skill' AS relation_type FROM d
       UNION ALL SELECT DISTINCT 'Tasks', 2, {clean("'source ' || source")}, {clean("'language ' || lang")}, 'has_task' FROM documents),
x AS (SELECT DISTINCT {stable("'docs'", "sheet_name", "CAST(row_number AS VARCHAR)", "source_label", "target_label", "relation_type")} AS relation_id, {slug("source_label")} AS source_id, {slug("target_label")} AS target_id FROM x0),
own AS (SELECT DISTINCT source_file, concept_id FROM d UNION SELECT DISTINCT source_file, concept_id FROM i)"""

VECTORS = "v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def nearest(where: str, k: int, prefix: str = "") -> str:
    """CTE near: query_id, id, score, rank of the k nearest among the vectors that satisfy ``where``."""
    return f"""{VECTORS},
pairs AS (SELECT q.vec_id AS query_id, '{prefix}' || c.id AS id, c.vec_id, c.label, greatest(0.0::DOUBLE, round(list_cosine_similarity(q.e, c.e), 9)) AS score FROM v q CROSS JOIN v c WHERE q.vec_id % 100 = 0 AND {where}),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= {k})"""


LEXICAL = f"""
items AS (SELECT id, list_distinct({terms("whole")}) AS ts, list_distinct({terms("title")}) AS tt, {penalty("whole")} AS penalty FROM d),
q AS (SELECT item_id AS query_id, {query_terms("coalesce(text, '')")} AS qt FROM benchmark),
held AS (SELECT id, unnest(ts) AS term FROM items), wanted AS (SELECT query_id, unnest(qt) AS term FROM q), titled AS (SELECT id, unnest(tt) AS term FROM items),
n AS (SELECT query_id, id, count(*) AS n, {", ".join(f"count(*) FILTER (term IN ({', '.join(repr(t) for t in p.terms)})) AS p{k}" for k, p in enumerate(CFG.phrases))}, count(*) FILTER (term IN ({", ".join(repr(t) for t in CFG.operational_terms)})) AS op FROM held JOIN wanted USING (term) GROUP BY ALL),
nt AS (SELECT query_id, id, count(*) AS nt FROM titled JOIN wanted USING (term) GROUP BY ALL),
both_ AS (SELECT n.*, coalesce(nt, 0) AS nt FROM n LEFT JOIN nt USING (query_id, id)),
scored AS (SELECT *, round(least(0.98::DOUBLE, 0.45::DOUBLE + least(0.25::DOUBLE, 0.04::DOUBLE * n) + least(0.25::DOUBLE, 0.08::DOUBLE * nt){"".join(f" + CASE WHEN p{k} = {len(p.terms)} THEN {p.boost}::DOUBLE ELSE 0.0::DOUBLE END" for k, p in enumerate(CFG.phrases) if p.lexical)}), 9) AS score FROM both_),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {CFG.lexical_limit})"""
BONUS = "least(0.16::DOUBLE, 0.025::DOUBLE * n) + least(0.18::DOUBLE, 0.06::DOUBLE * nt) + least(0.12::DOUBLE, 0.04::DOUBLE * op)" + "".join(f" + CASE WHEN p{k} = {len(p.terms)} THEN {p.boost}::DOUBLE ELSE 0.0::DOUBLE END" for k, p in enumerate(CFG.phrases))


def top(what: str, partition: str, order: str, name: str = "rank") -> str:
    return f"{what}, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS INTEGER) AS {name}"


def round9(x: str) -> str:
    return f"round({x}, 9)"


KIND = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in CFG.relation_weights.items()) + " ELSE 0.5::DOUBLE END"
PHRASE_COUNTS = ", ".join(f"len(list_filter(o, lambda t: t IN ({', '.join(repr(t) for t in p.terms)}))) AS p{k}" for k, p in enumerate(CFG.phrases))
OPERATIONAL = f"len(list_filter(o, lambda t: t IN ({', '.join(repr(t) for t in CFG.operational_terms)}))) AS op"


def hop(number: int, frontier: str, room: str) -> str:
    """CTEs of one round: e (scored edges), k (kept), s (looked at), r (neighbours reached first)."""
    decay, least = (1.0, 0.28) if number == 1 else (0.65, 0.42)
    fresh = "TRUE" if number == 1 else "NOT EXISTS (SELECT 1 FROM k1 WHERE k1.query_id = s.query_id AND k1.relation_id = s.relation_id)"
    score = round9(f"(0.35::DOUBLE * coalesce(seed_score, 0.5::DOUBLE) + 0.25::DOUBLE * {KIND} + CASE WHEN coalesce(c.has_evidence, FALSE) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + least(0.25::DOUBLE, 0.04::DOUBLE * len(list_intersect(qt, rt)))) * {decay}::DOUBLE")
    n = number
    return f"""
s{n}_ AS (SELECT f.query_id, f.concept_id, a.neighbor_id, direction, relation_id, relation_type, ordinal, {score} AS edge_score
          FROM {frontier} f JOIN adj a ON f.concept_id = a.concept_id JOIN q ON q.query_id = f.query_id LEFT JOIN c ON c.concept_id = a.neighbor_id),
e{n} AS (SELECT *, {n} AS hop, edge_score >= {least} AS accepted, {fresh} AS fresh, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, edge_score DESC, relation_id, direction) AS pos FROM s{n}_ s),
f{n} AS (SELECT * FROM e{n} WHERE accepted AND fresh QUALIFY row_number() OVER (PARTITION BY query_id, relation_id ORDER BY pos) = 1),
k{n} AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS seq_ FROM f{n}) f JOIN {room} r ON f.query_id = r.query_id WHERE seq_ <= room),
l{n} AS (SELECT r.query_id, CASE WHEN room <= 0 THEN 0 WHEN coalesce(n, 0) >= room THEN last_ ELSE 1000000000 END AS last_ FROM {room} r LEFT JOIN (SELECT query_id, count(*) AS n, max(pos) AS last_ FROM k{n} GROUP BY 1) USING (query_id)),
seen{n} AS (SELECT e.* FROM e{n} e JOIN l{n} USING (query_id) WHERE pos <= last_),
r{n} AS (SELECT * FROM seen{n} s WHERE accepted AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.concept_id = s.neighbor_id) QUALIFY row_number() OVER (PARTITION BY query_id, neighbor_id ORDER BY pos) = 1)"""


TABLE_VECTORS = "nv AS (SELECT count(*) AS nv FROM embeddings), vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
STORE = f"""{DOCS}, {IMAGES}, {TABLE_VECTORS},
dv AS (SELECT d.*, e FROM d, nv, vec WHERE vec_id = CAST(section_id AS BIGINT) % nv), iv AS (SELECT i.*, e FROM i, nv, vec WHERE vec_id = (CAST(section_id AS BIGINT) * 7 + 3) % nv),
y0 AS (SELECT 'Skills' AS sheet_name, CAST(section_id AS INTEGER) AS row_number, title AS source_label, {clean("'source ' || source_file")} AS target_label, 'has_skill' AS relation_type, 'SWO' AS k1, 'Skill' AS k2 FROM d
       UNION ALL SELECT DISTINCT 'Tasks', 2, {clean("'source ' || source")}, {clean("'language ' || lang")}, 'has_task', 'Skill', 'Task' FROM documents),
y AS (SELECT DISTINCT {stable("'docs'", "sheet_name", "CAST(row_number AS VARCHAR)", "source_label", "target_label", "relation_type")} AS relation_id, {slug("source_label")} AS source_id, {slug("target_label")} AS target_id, relation_type, source_label, target_label,
      trim(source_label || ' ' || replace(relation_type, '_', ' ') || ' ' || target_label || '.') AS description,
      substring(concat_ws(' | ', CASE WHEN source_label <> '' THEN k1 || ': ' || source_label END, CASE WHEN target_label <> '' THEN k2 || ': ' || target_label END), 1, 1000) AS evidence FROM y0),
rt AS (SELECT *, list_distinct({terms("description || ' ' || source_label || ' ' || target_label || ' ' || evidence")}) AS rt FROM y),
adj AS (SELECT source_id AS concept_id, target_id AS neighbor_id, 'out' AS direction, relation_id, relation_type, rt FROM rt UNION ALL SELECT target_id, source_id, 'in', relation_id, relation_type, rt FROM rt),
c0 AS (SELECT concept_id, count(DISTINCT key) FILTER (kind = 'text') AS texts, bool_or(kind <> 'edge') AS has_evidence
       FROM (SELECT concept_id, id AS key, 'text' AS kind FROM d UNION ALL SELECT concept_id, image_id, 'image' FROM i UNION ALL SELECT source_id, relation_id, 'edge' FROM y UNION ALL SELECT target_id, relation_id, 'edge' FROM y) GROUP BY 1),
c AS (SELECT *, CASE WHEN has_evidence THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM c0),
pv AS (SELECT concept_id, unnest(e) AS x, unnest(range(len(e))) AS at_, w FROM (SELECT concept_id, e, 1.0::DOUBLE AS w FROM dv UNION ALL SELECT concept_id, e, 0.8::DOUBLE FROM iv)),
mv AS (SELECT concept_id, at_, sum(x * w) / sum(w) AS x FROM pv GROUP BY ALL), uv AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY concept_id)) AS norm FROM mv),
cv AS (SELECT concept_id, list_transform(list(CAST(x / norm AS FLOAT) ORDER BY at_), lambda x: CAST(x AS DOUBLE)) AS e FROM uv GROUP BY 1
       UNION ALL SELECT concept_id, e FROM c, nv, vec WHERE NOT has_evidence AND vec_id = (length(concept_id) * 31 + ascii(right(concept_id, 1)) * 17) % nv),
q AS (SELECT item_id AS query_id, coalesce(text, '') AS query, {query_terms("coalesce(text, '')")} AS qt, e FROM benchmark, nv, vec WHERE vec_id = (item_id * 13 + 5) % nv)"""
LONG = "greatest(0.0::DOUBLE, round(list_cosine_similarity(q.e, x.e), 9))"
RETRIEVED = f"""{STORE},
items AS (SELECT 'text' AS collection, id, concept_id, title, content AS body, source_file, section_id, list_distinct({terms("whole")}) AS ts, list_distinct({terms("title")}) AS tt, {penalty("whole")} AS penalty, array_to_string(list_slice({terms("whole")}, 1, 80), ' ') AS print FROM d
          UNION ALL SELECT 'image', image_id, concept_id, title, description, source_file, section_id, list_distinct({terms("w")}), list_distinct({terms("title")}), {penalty("w")}, array_to_string(list_slice({terms("w")}, 1, 80), ' ') FROM (SELECT *, title || '  ' || description AS w FROM i)),
near_t AS (SELECT {top("query_id, 'text' AS collection, id, " + LONG + " AS score", "query_id", "score DESC, id")} FROM q, dv x QUALIFY rank <= {4 * CFG.text_top_k}),
near_i AS (SELECT {top("query_id, 'image' AS collection, image_id AS id, " + LONG + " AS score", "query_id", "score DESC, id")} FROM q, iv x QUALIFY rank <= {4 * CFG.image_top_k}),
near_c AS (SELECT {top("query_id, concept_id, " + LONG + " AS score", "query_id", "score DESC, concept_id", "vector_rank")} FROM q, cv x QUALIFY vector_rank <= {max(5 * CFG.node_top_k, 20)}),
met AS (SELECT query_id, collection, id, len(o) AS n, nt, penalty, {PHRASE_COUNTS}, {OPERATIONAL} FROM (SELECT query_id, collection, id, penalty, list_intersect(qt, ts) AS o, len(list_intersect(qt, tt)) AS nt FROM q, items)),
lex AS (SELECT {top("query_id, collection, id, " + round9("least(0.98::DOUBLE, 0.45::DOUBLE + least(0.25::DOUBLE, 0.04::DOUBLE * n) + least(0.25::DOUBLE, 0.08::DOUBLE * nt)" + "".join(f" + CASE WHEN p{k} = {len(p.terms)} THEN {p.boost}::DOUBLE ELSE 0.0::DOUBLE END" for k, p in enumerate(CFG.phrases) if p.lexical) + ")") + " AS score", "query_id, collection", "score DESC, id")} FROM met WHERE n > 0 QUALIFY rank <= {CFG.lexical_limit}),
both_ AS (SELECT query_id, collection, id, score, 0 AS src FROM near_t UNION ALL SELECT query_id, collection, id, score, 0 FROM near_i UNION ALL SELECT query_id, collection, id, score, 1 FROM lex),
merged AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, collection, id ORDER BY score DESC, src) = 1),
bonus AS (SELECT query_id, collection, id, penalty, {BONUS} AS bonus FROM met),
hits AS (SELECT {top("m.*, " + round9("greatest(0.0::DOUBLE, m.score + bonus - penalty)") + " AS rr", "query_id, collection", "rr DESC, id", "hit_rank")} FROM merged m JOIN bonus USING (query_id, collection, id) QUALIFY hit_rank <= CASE collection WHEN 'text' THEN {CFG.text_top_k} ELSE {CFG.image_top_k} END),
nodes AS (SELECT {top("n.*, has_evidence, " + round9("score * weight") + " AS rr", "query_id", "rr DESC, vector_rank", "node_rank")} FROM near_c n JOIN c USING (concept_id)),
extra AS (SELECT * FROM nodes WHERE node_rank > {CFG.node_top_k} AND NOT has_evidence AND score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_rank) <= {CFG.seed_limit}),
seeds_ AS (SELECT query_id, concept_id, score, rr FROM hits JOIN items USING (collection, id) UNION ALL SELECT query_id, concept_id, score, rr FROM nodes WHERE node_rank <= {CFG.node_top_k} UNION ALL SELECT query_id, concept_id, score, rr FROM extra),
seeds AS (SELECT query_id, concept_id, max(CASE WHEN rr <> 0 THEN rr ELSE score END) AS seed_score FROM seeds_ GROUP BY 1, 2),
start AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY concept_id) AS ordinal FROM seeds), room1 AS (SELECT DISTINCT query_id, {CFG.relation_limit} AS room FROM seeds),{hop(1, "start", "room1")},
further AS (SELECT query_id, neighbor_id AS concept_id, NULL::DOUBLE AS seed_score, pos AS ordinal FROM r1 WHERE edge_score >= 0.5),
room2 AS (SELECT r.query_id, room - coalesce(n, 0) AS room FROM room1 r LEFT JOIN (SELECT query_id, count(*) AS n FROM k1 GROUP BY 1) USING (query_id)),{hop(2, "further", "room2")},
trace AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, pos) AS INTEGER) AS seq FROM (SELECT query_id, hop, concept_id, neighbor_id, direction, relation_id, relation_type, edge_score, pos FROM k1 UNION ALL SELECT query_id, hop, concept_id, neighbor_id, direction, relation_id, relation_type, edge_score, pos FROM k2)),
visited AS (SELECT query_id, concept_id FROM seeds UNION SELECT query_id, neighbor_id FROM r1 UNION SELECT query_id, neighbor_id FROM seen2 WHERE accepted),
low AS (SELECT query_id, relation_id, edge_score FROM (SELECT query_id, relation_id, edge_score, hop, pos FROM seen1 WHERE NOT accepted UNION ALL SELECT query_id, relation_id, edge_score, hop, pos FROM seen2 WHERE NOT accepted) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, pos) <= 20),
expanded AS (SELECT v.query_id, t.collection, t.id, {round9("greatest(0.0::DOUBLE, 0.0::DOUBLE + (bonus + 0.2::DOUBLE) - b.penalty)")} AS rr FROM visited v JOIN items t USING (concept_id) JOIN bonus b ON b.query_id = v.query_id AND b.collection = t.collection AND b.id = t.id
             WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = v.query_id AND h.collection = t.collection AND h.id = t.id)),
rows0 AS (SELECT query_id, collection, id, rr, 0 AS origin FROM hits UNION ALL SELECT query_id, collection, id, rr, 1 FROM expanded),
rows1 AS (SELECT r.*, title, concept_id, source_file, section_id, body, print, penalty >= 0.5 AND rr < 0.85 AS generic FROM rows0 r JOIN items USING (collection, id)),
rows2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection, id, generic ORDER BY origin, rr DESC, id) AS nid FROM rows1),
rows3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection, print, generic OR nid > 1 ORDER BY origin, rr DESC, id) AS nprint FROM rows2),
marked AS (SELECT *, CASE WHEN generic THEN 'generic' WHEN nid > 1 OR nprint > 1 THEN 'duplicate' ELSE 'kept' END AS verdict FROM rows3),
context AS (SELECT {top("*", "query_id, collection", "rr DESC, origin, id")} FROM marked WHERE verdict = 'kept' QUALIFY rank <= CASE collection WHEN 'text' THEN {CFG.max_context_text} ELSE {CFG.max_context_images} END),
relations AS (SELECT {top("t.query_id, t.edge_score, t.seq, y.*", "query_id", "edge_score DESC, seq")} FROM trace t JOIN y USING (relation_id) QUALIFY rank <= {CFG.max_context_relations})"""


def excerpt(x: str) -> str:
    whole = f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"
    cut = f"substring({whole}, 1, 1000)"
    at = "greatest(" + ", ".join(f"CASE WHEN contains({cut}, '{m}') THEN length({cut}) - strpos(reverse({cut}), '{m}') ELSE -1 END" for m in (".", ";", "।")) + ")"
    return f"CASE WHEN length({whole}) <= 1000 THEN {whole} WHEN {at} >= 700 THEN regexp_replace(substring({cut}, 1, {at} + 1), '^{SPACE}|{SPACE}$', '', 'g') ELSE regexp_replace({cut}, '{SPACE}$', '') || '...' END"


CITED = "'[' || coalesce(nullif(title, ''), 'Untitled') || ', concept: ' || concept_id || ']'"
ANSWERED = f"""{RETRIEVED},
bullets AS (SELECT query_id, collection, count(*) AS n, string_agg('- ' || {excerpt("body")} || ' ' || {CITED}, chr(10) ORDER BY rank) AS lines FROM context WHERE rank <= CASE collection WHEN 'text' THEN {CFG.compact_text} ELSE {CFG.compact_images} END GROUP BY 1, 2),
arrows AS (SELECT query_id, count(*) AS n, string_agg('- ' || source_id || ' --' || relation_type || '--> ' || target_id || ': ' || description, chr(10) ORDER BY rank) AS lines FROM relations WHERE rank <= {CFG.compact_relations} GROUP BY 1),
a AS (SELECT q.query_id, query, coalesce(t.n, 0) AS nt, coalesce(i.n, 0) AS ni, coalesce(r.n, 0) AS nr, t.lines AS tl, i.lines AS il, r.lines AS rl
      FROM q LEFT JOIN bullets t ON t.query_id = q.query_id AND t.collection = 'text' LEFT JOIN bullets i ON i.query_id = q.query_id AND i.collection = 'image' LEFT JOIN arrows r ON r.query_id = q.query_id)"""
TITLES = f"""{RETRIEVED},
b AS (SELECT q.query_id, lower(query) AS query, coalesce(t.n, 0) AS nt, coalesce(i.n, 0) AS ni, coalesce(r.n, 0) AS nr, coalesce(x.n, 0) AS nx, coalesce(x.deepest, 0) AS deepest, coalesce(titles, '') AS titles, coalesce(first_, '') AS first_ FROM q
      LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(lower(title), ' | ' ORDER BY rank) AS titles, first(lower(title) ORDER BY rank) AS first_ FROM context WHERE collection = 'text' GROUP BY 1) t USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS n FROM context WHERE collection = 'image' GROUP BY 1) i USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM relations GROUP BY 1) r USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS n, max(hop) AS deepest FROM trace GROUP BY 1) x USING (query_id)),
ok AS (SELECT *, contains(titles, coalesce(string_split(query, ' ')[3], '')) AS any_of, substring(query, 1, 2) || ' ' AS begin_ FROM b),
g AS (SELECT *, concat_ws(',', CASE WHEN NOT any_of THEN 'any_of' END, CASE WHEN contains(first_, begin_) THEN 'first_not' END, CASE WHEN ni < 3 THEN 'min_images' END, CASE WHEN nx < 10 THEN 'min_trace' END, CASE WHEN contains(titles, begin_ || begin_) THEN 'none_of' END) AS failed FROM ok)"""
PASSED = f"nt + ni > 0 AND deepest <= {CFG.max_hops} AND nt <= {CFG.max_context_text} AND ni <= {CFG.max_context_images} AND nr <= {CFG.max_context_relations}"
def json_size(*fields: str) -> str:
    """Characters of a JSON object of ``name: expression`` fields."""
    return f"length(CAST(to_json({{{', '.join(fields)}}}) AS VARCHAR))"


REFERRED = ("'id': id", "'title': title", "'source_file': source_file", "'concept_id': concept_id")
NOTE_SIZE = 500  # keys, brackets and notes of a compression, at most
SIZES = f"""
wb AS (SELECT query_id, sum({json_size(*REFERRED, "'body': body")}) AS whole, sum(CASE WHEN rank <= CASE collection WHEN 'text' THEN {CFG.compact_text} ELSE {CFG.compact_images} END THEN {json_size(*REFERRED, f"'excerpt_text': {excerpt('body')}", f"'citation': {CITED}")} + {json_size(*REFERRED)} + 2 ELSE 0 END) AS small FROM context GROUP BY 1),
wr AS (SELECT query_id, sum(size) AS whole, sum(size + 30) FILTER (rank <= {CFG.compact_relations}) AS small FROM (SELECT query_id, rank, {json_size("'relation_id': relation_id", "'source_id': source_id", "'target_id': target_id", "'relation_type': relation_type", "'description': description", "'graph_relevance_score': edge_score")} AS size FROM relations) GROUP BY 1),
wt AS (SELECT query_id, sum(size) AS whole FROM (SELECT query_id, {json_size("'hop': hop", "'from': concept_id", "'to': neighbor_id", "'direction': direction", "'relation_id': relation_id", "'relation_type': relation_type", "'edge_score': edge_score")} AS size FROM trace
       UNION ALL SELECT query_id, {json_size("'collection': collection", *REFERRED, "'section_id': section_id")} FROM context) GROUP BY 1)"""
NOTE = "This draft is based mainly on retrieved course text/image evidence; no supporting relation trace was retrieved."
WEAK = (("nt", "No text evidence was retrieved."), ("ni", "No image or diagram description evidence was retrieved."), ("nr", "No relation trace was retrieved; answer should rely mainly on text/image evidence."))


def unescaped(x: str) -> str:
    for entity, mark in (("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {mark})"
    return x


def markup_text(x: str) -> str:
    return clean(unescaped(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


PAGES = f"""
p0 AS (SELECT page_id, url, 'page-' || page_id || '.html' AS source_file, coalesce(html, '') AS html, split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1) AS article FROM pages),
p1 AS (SELECT *, {markup_text("split_part(split_part(html, '<title>', 2), '</title>', 1)")} AS named, {markup_text("split_part(split_part(article, '<h1>', 2), '</h1>', 1)")} AS heading,
       list_filter(list_transform(list_slice(string_split(article, '<p>'), 2, 1000000), lambda x: {markup_text("split_part(x, '</p>', 1)")}), lambda x: x <> '') AS parts, len(regexp_extract_all(article, '<(p|b|br)>')) AS inner_ FROM p0),
pg AS (SELECT *, coalesce(nullif(named, ''), source_file) AS title, {clean("array_to_string(parts, chr(10))")} AS body, {clean("url")} AS link FROM p1)"""
TREE = f"""{PAGES},
tree AS (SELECT source_file, -1 AS pos, 0 AS level, title, {slug("title", "section")} AS section_id, -2 AS parent_pos, NULL AS parent_title, title AS breadcrumb, CASE WHEN heading = '' THEN 'Map' ELSE heading END AS child_titles, CASE WHEN heading = '' THEN body ELSE '' END AS content FROM pg
         UNION ALL SELECT source_file, 7, 1, heading, 'page-' || page_id || '-' || {slug("heading", "section")}, -1, title, title || '|' || heading, 'Map', body FROM pg WHERE heading <> ''
         UNION ALL SELECT source_file, 9 + inner_, 2, 'Map', 'page-' || page_id || '-map' || CASE WHEN {slug("heading", "section")} = 'map' THEN '-2' ELSE '' END, CASE WHEN heading = '' THEN -1 ELSE 7 END, CASE WHEN heading = '' THEN title ELSE heading END,
                title || CASE WHEN heading = '' THEN '' ELSE '|' || heading END || '|Map', '', {clean("link || ' page Map of ' || page_id")} FROM pg)"""
DIAGRAMS = f"""{TREE},
g AS (SELECT pg.*, section_id, parent_title, 'Map of ' || page_id AS caption, array_to_string(list_filter([link, 'page'], lambda x: x <> ''), '|') AS labels, '<svg viewBox="0 0 9 9"><text>' || url || '</text><text>page</text></svg>' AS raw FROM pg JOIN tree USING (source_file) WHERE level = 2),
gi AS (SELECT *, {stable("source_file", "section_id", "'1'", "'svg'", "labels", "caption")} AS image_id FROM g)"""

ORACLE_SQL = {
    "text_functions": f"""
        WITH {DOCS}, u AS (SELECT *, sha1(unhex('{URL}') || encode('chp-textchunk:' || id)) AS h FROM d)
        SELECT section_id, sha1({clean("content")}) AS cleaned, {slug("title", "section")} AS slug, type, id, {UUID} AS uuid,
               CASE WHEN regexp_matches(content, '[\\x{{0900}}-\\x{{097F}}]') THEN 'hi-en' ELSE 'en' END AS language, CAST({penalty("whole")} AS DOUBLE) AS penalty,
               sha1(array_to_string(list_slice({terms("whole")}, 1, 80), ' ')) AS fingerprint FROM u""",
    "query_term_sets": f"""
        WITH q AS (SELECT 'b' || item_id AS query_id, coalesce(text, '') AS query FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations WHERE role = 'user'),
        s AS (SELECT query_id, {query_terms("query")} AS ts FROM q)
        SELECT query_id, CAST(len(ts) AS BIGINT) AS n_terms, array_to_string(list_sort(ts), '|') AS terms FROM s""",
    "excerpts": f"""
        WITH {DOCS}, s AS (SELECT *, regexp_replace(content, '^{SPACE}|{SPACE}$', '', 'g') AS w FROM d), c AS (SELECT *, substring(w, 1, 1000) AS cut FROM s),
        a AS (SELECT *, greatest(CASE WHEN contains(cut, '.') THEN length(cut) - strpos(reverse(cut), '.') ELSE -1 END, CASE WHEN contains(cut, ';') THEN length(cut) - strpos(reverse(cut), ';') ELSE -1 END, CASE WHEN contains(cut, '।') THEN length(cut) - strpos(reverse(cut), '।') ELSE -1 END) AS at_ FROM c)
        SELECT section_id, CASE WHEN length(w) <= 1000 THEN w WHEN at_ >= 700 THEN regexp_replace(substring(cut, 1, at_ + 1), '^{SPACE}|{SPACE}$', '', 'g') ELSE regexp_replace(cut, '{SPACE}$', '') || '...' END AS excerpt,
               '[' || coalesce(nullif(title, ''), 'Untitled') || ', concept: ' || concept_id || ']' AS citation FROM a""",
    "sheet_rows": f"SELECT CAST(row_number() OVER (ORDER BY o) + 1 AS INTEGER) AS row_number, {clean('v1')} AS skill, {clean('v2')} AS task FROM ({SHEET_SQL['Tasks']})",
    "workbook_rows": """
        SELECT s_nationkey || '-' || CAST(floor(s_suppkey / 10000) AS BIGINT) || '.xlsx' AS file, 'SWO' AS sheet, CAST(row_number() OVER (PARTITION BY s_nationkey, floor(s_suppkey / 10000) ORDER BY s_suppkey) + 1 AS INTEGER) AS row_number,
               n_name AS pwo, s_name AS swo, s_suppkey AS suppkey, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "relation_edges": f"WITH {edges()} SELECT relation_id, source_id, target_id, relation_type, description, sheet_name, CAST(row_number AS INTEGER) AS row_number, evidence FROM e",
    "control_point_edges": f"""
        WITH c AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) + 1 AS row_number, 'order ' || l_orderkey AS task, 'order ' || l_orderkey || ' line ' || l_linenumber AS point FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT {stable("'star.xlsx'", "'Control Point'", "CAST(row_number AS VARCHAR)", "task", "point", "'has_control_point'")} AS relation_id, {slug("task")} AS source_id, {slug("point")} AS target_id, 'has_control_point' AS relation_type,
               task || ' has control point ' || point || '.' AS description, 'Control Point' AS sheet_name, CAST(row_number AS INTEGER) AS row_number, 'Task: ' || task || ' | Control Point: ' || point AS evidence FROM c""",
    "graph_adjacency": f"WITH {edges()} SELECT source_id AS concept_id, target_id AS neighbor_id, 'out' AS direction, relation_id, relation_type FROM e UNION ALL SELECT target_id, source_id, 'in', relation_id, relation_type FROM e",
    "concept_node_table": f"""
        WITH {DOCS}, {IMAGES}, {edges()},
        m AS (SELECT concept_id, title AS label, 0 AS rank, id AS key, 'text' AS kind, source_file, NULL AS relation_type FROM d
              UNION ALL SELECT concept_id, title, 1, image_id, 'image', source_file, NULL FROM i UNION ALL SELECT source_id, source_label, 2, relation_id, 'source', NULL, relation_type FROM e
              UNION ALL SELECT target_id, target_label, 3, relation_id, 'target', NULL, relation_type FROM e),
        g AS (SELECT concept_id, first({clean("label")} ORDER BY rank, key) AS label,
              {", ".join(f"coalesce(list_sort(list(DISTINCT key) FILTER (kind = '{k}')), []) AS {k}_" for k in ("text", "image", "source", "target"))},
              coalesce(list_sort(list(DISTINCT relation_type) FILTER (relation_type <> '')), []) AS rt, coalesce(list_sort(list(DISTINCT source_file) FILTER (source_file <> '')), []) AS sf FROM m GROUP BY concept_id)
        SELECT concept_id, coalesce(nullif(label, ''), concept_id) AS label, {", ".join(f"sha1(array_to_string({k}_, '|')) AS {n}" for k, n in (("text", "text_chunk_ids"), ("image", "image_ids"), ("source", "source_relation_ids"), ("target", "target_relation_ids")))},
               array_to_string(rt, '|') AS relation_types, array_to_string(sf, '|') AS source_files, CAST(len(text_) AS INTEGER) AS texts, CAST(len(image_) AS INTEGER) AS images, CAST(len(source_) AS INTEGER) AS sources, CAST(len(target_) AS INTEGER) AS targets,
               len(text_) + len(image_) > 0 AS has_evidence, CASE WHEN len(text_) + len(image_) > 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM g""",
    "module_relation_pairs": f"WITH {DOCS}, {IMAGES}, {DOC_EDGES} SELECT DISTINCT source_file, relation_id FROM own JOIN x ON concept_id = source_id OR concept_id = target_id",
    "module_concept_pairs": f"WITH {DOCS}, {IMAGES}, {DOC_EDGES} SELECT source_file, concept_id FROM own",
    "module_bundle_sizes": f"""
        WITH {DOCS}, {IMAGES}, {DOC_EDGES}, r AS (SELECT source_file, count(DISTINCT relation_id) AS n FROM own JOIN x ON concept_id = source_id OR concept_id = target_id GROUP BY 1), o AS (SELECT source_file, count(*) AS n FROM own GROUP BY 1),
        t AS (SELECT source_file, count(*) AS n FROM d GROUP BY 1), p AS (SELECT source_file, count(*) AS n FROM i GROUP BY 1)
        SELECT o.source_file, CAST(coalesce(t.n, 0) AS INTEGER) AS text_chunks, CAST(coalesce(p.n, 0) AS INTEGER) AS image_chunks, CAST(coalesce(r.n, 0) AS INTEGER) AS relations, CAST(o.n AS INTEGER) AS concepts
        FROM o LEFT JOIN t USING (source_file) LEFT JOIN p USING (source_file) LEFT JOIN r USING (source_file)""",
    "upsert_store": f"""
        WITH {DOCS}, u AS (SELECT *, sha1(unhex('{URL}') || encode('chp-textchunk:' || id)) AS h FROM d)
        SELECT {UUID} AS uuid, id, CASE WHEN CAST(section_id AS BIGINT) % 2 = 0 THEN 'new ' ELSE '' END || title AS title, section_id FROM u""",
    "concept_vectors": f"""
        WITH {VECTORS}, p AS (SELECT 'label-' || label AS concept_id, unnest(e) AS x, unnest(range(len(e))) AS at_, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS w FROM v),
        m AS (SELECT concept_id, at_, sum(x * w) / sum(w) AS x FROM p GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY concept_id)) AS norm FROM m)
        SELECT concept_id, CAST(at_ AS INTEGER) AS at, round(x / norm, 6) AS x FROM n""",
    "relation_only_node_text": f"""
        WITH {edges()},
        m AS (SELECT source_id AS concept_id, source_label AS label, 2 AS rank, relation_id, relation_type FROM e UNION ALL SELECT target_id, target_label, 3, relation_id, relation_type FROM e),
        g AS (SELECT concept_id, first(label ORDER BY rank, relation_id) AS label, list_sort(list(DISTINCT relation_type)) AS rt, list_slice(list_concat(coalesce(list_sort(list(DISTINCT relation_id) FILTER (rank = 2)), []), coalesce(list_sort(list(DISTINCT relation_id) FILTER (rank = 3)), [])), 1, 10) AS ids FROM m GROUP BY 1),
        k AS (SELECT concept_id, unnest(ids) AS relation_id, unnest(range(len(ids))) AS at_ FROM g), t AS (SELECT concept_id, string_agg(description, ' ' ORDER BY at_) AS d FROM k JOIN e USING (relation_id) GROUP BY 1)
        SELECT concept_id, coalesce(nullif(label, ''), concept_id) || ' Relation types: ' || array_to_string(rt, ', ') || ' ' || d AS text FROM g JOIN t USING (concept_id)""",
    "vector_top_k": f"WITH {nearest('TRUE', 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM near",
    "vector_index_top_k": f"WITH {nearest('TRUE', 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM near",
    "concept_hit_resolution": f"WITH {nearest('TRUE', 3)} SELECT query_id, rank, id, 'label-' || label AS concept_id, label % 2 = 0 AS concept_found FROM near",
    "reranked_nodes": f"""
        WITH {nearest("TRUE", 25, "n")}, w AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM near), r AS (SELECT *, round(score * weight, 9) AS rerank FROM w)
        SELECT query_id, id AS concept_id, round(score, 6) AS score, round(rerank, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, rank) AS INTEGER) AS node_rank FROM r QUALIFY node_rank <= {CFG.node_top_k}""",
    "relation_seed_nodes": f"""
        WITH {nearest("TRUE", 25, "n")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END, 9) DESC, rank) AS node_rank FROM near)
        SELECT query_id, id AS concept_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS seed_rank FROM r WHERE node_rank > {CFG.node_top_k} AND vec_id % 2 = 1 AND score >= 0.3 QUALIFY seed_rank <= {CFG.seed_limit}""",
    "lexical_top_k": f"WITH {DOCS}, {LEXICAL} SELECT query_id, id, score, rank FROM lex",
    "reranked_evidence": f"""
        WITH {DOCS}, {LEXICAL}, m AS (SELECT *, CASE WHEN score > 0.7 THEN 1 ELSE 0 END AS source_rank, greatest(score, 0.7::DOUBLE) AS s FROM lex),
        r AS (SELECT m.*, round(greatest(0.0::DOUBLE, s + {BONUS} - penalty), 9) AS rr FROM m JOIN items USING (id))
        SELECT query_id, id, round(s, 6) AS score, source_rank, round(rr, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, id) AS INTEGER) AS hit_rank FROM r QUALIFY hit_rank <= 5""",
    "collection_validation": f"""
        WITH {DOCS}, {IMAGES}, {edges()},
        c AS (SELECT concept_id FROM d UNION SELECT concept_id FROM i UNION SELECT source_id FROM e UNION SELECT target_id FROM e),
        k AS (SELECT 'text' AS collection, id AS key, title = '' OR content = '' OR source_file IS NULL AS missing FROM d UNION ALL SELECT 'image', image_id, coalesce(description, '') = '' FROM i UNION ALL SELECT 'relation', relation_id, FALSE FROM e UNION ALL SELECT 'concept', concept_id, FALSE FROM c),
        r AS (SELECT collection, count(*) AS n, count(*) FILTER (missing) AS n_missing, count(*) = count(DISTINCT key) AS unique_keys FROM k GROUP BY 1), f AS (SELECT *, unique_keys AND n_missing = 0 AS passed FROM r)
        SELECT collection, CAST(n AS BIGINT) AS n, CAST(n_missing AS BIGINT) AS n_missing, unique_keys, passed FROM f UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), CAST(sum(n_missing) AS BIGINT), bool_and(unique_keys), bool_and(passed) FROM f""",
    "missing_fields": f"WITH {IMAGES} SELECT image_id AS key, 'description' AS missing FROM i WHERE description IS NULL OR NOT contains(description, '?')",
    "encoded_vectors": f"""
        WITH t AS (SELECT 'text' AS collection, CAST(doc_id AS VARCHAR) AS id, 'passage: ' || text AS whole FROM documents WHERE regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') <> ''
                   UNION ALL SELECT 'query', CAST(item_id AS VARCHAR), 'query: ' || text FROM benchmark WHERE regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') <> ''),
        w AS (SELECT collection, id, md5(unnest(regexp_extract_all(lower(whole), '[\\p{{L}}\\p{{N}}_]+'))) AS m FROM t),
        p AS (SELECT collection, id, CAST('0x' || substring(m, 1, 2) AS INTEGER) % 64 AS at_, sum(CASE WHEN CAST('0x' || substring(m, 15, 2) AS INTEGER) >= 128 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
        n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY collection, id)) AS norm FROM p)
        SELECT collection, id, at_ AS at, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 6) AS x FROM n WHERE x <> 0""",
    "embedding_sources": f"""
        WITH {DOCS}, {IMAGES}, {DOC_EDGES}, k AS (SELECT concept_id, bool_or(filled) AS filled FROM (SELECT concept_id, trim(content) <> '' AS filled FROM d UNION ALL SELECT concept_id, TRUE FROM i UNION ALL SELECT source_id, FALSE FROM x UNION ALL SELECT target_id, FALSE FROM x) GROUP BY 1)
        SELECT CASE WHEN filled THEN 'linked_text_image_vectors' ELSE 'relation_label_text' END AS embedding_source, count(*) AS n FROM k GROUP BY 1""",
    "embedding_skipped": f"""
        WITH {DOCS}, {IMAGES} SELECT 'text' AS collection, id FROM d WHERE regexp_replace(content, '{SPACE}', '', 'g') = '' UNION ALL SELECT 'image', image_id FROM i WHERE description IS NULL OR NOT contains(description, '?')""",
    "graph_trace": f"WITH {RETRIEVED} SELECT query_id, seq, hop, concept_id AS from_id, neighbor_id AS to_id, direction, relation_id, relation_type, round(edge_score, 6) AS score FROM trace",
    "expanded_nodes": f"WITH {RETRIEVED} SELECT query_id, concept_id, has_evidence, weight, CAST(texts AS INTEGER) AS texts FROM visited JOIN c USING (concept_id)",
    "retrieve_context": f"""
        WITH {RETRIEVED} SELECT query_id, collection, id, rank, round(rr, 6) AS score FROM context UNION ALL SELECT query_id, 'relation', relation_id, rank, round(edge_score, 6) FROM relations""",
    "retrieval_dropped": f"""
        WITH {RETRIEVED} SELECT query_id, collection, id, verdict, round(rr, 6) AS score FROM marked WHERE verdict <> 'kept' UNION ALL SELECT query_id, 'relation', relation_id, 'low_score', round(edge_score, 6) FROM low""",
    "retrieval_diagnostics": f"""
        WITH {RETRIEVED}, v AS (SELECT query_id, count(*) FILTER (verdict = 'duplicate') AS du, count(*) FILTER (verdict = 'generic') AS ge FROM marked GROUP BY 1),
        b AS (SELECT query_id, count(*) FILTER (collection = 'text') AS tb, count(*) FILTER (collection = 'image') AS ib FROM context GROUP BY 1), r AS (SELECT query_id, count(*) AS rb FROM relations GROUP BY 1), w AS (SELECT query_id, count(*) AS de FROM low GROUP BY 1)
        SELECT query_id, coalesce(du, 0) AS dropped_duplicates, coalesce(ge, 0) AS dropped_generic, coalesce(tb, 0) AS text_blocks, coalesce(ib, 0) AS image_blocks, coalesce(rb, 0) AS relation_blocks, coalesce(de, 0) AS dropped_edges, coalesce(tb, 0) + coalesce(ib, 0) AS source_references
        FROM (SELECT query_id FROM q) LEFT JOIN v USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN w USING (query_id)""",
    "grounded_answers": f"""
        WITH {ANSWERED} SELECT query_id,
          regexp_replace('Query: ' || query || chr(10) || CASE WHEN nr = 0 THEN chr(10) || '{NOTE}' || chr(10) ELSE '' END || CASE WHEN nt > 0 THEN chr(10) || 'Key course evidence:' || chr(10) || tl ELSE '' END
            || CASE WHEN ni > 0 THEN chr(10) || chr(10) || 'Relevant diagram/image evidence:' || chr(10) || il ELSE '' END || CASE WHEN nr > 0 THEN chr(10) || chr(10) || 'Relevant graph relation context:' || chr(10) || rl ELSE '' END, '^\\s+|\\s+$', '', 'g') AS answer,
          CASE WHEN regexp_matches(query, '[\\x{{0900}}-\\x{{097F}}]') THEN 'hi-en' ELSE 'en' END AS language, 'extractive' AS mode, CAST(ni AS INTEGER) AS image_evidence_count, CAST(nt + ni AS INTEGER) AS citation_count,
          '{{"has_text_evidence":' || (nt > 0) || ',"has_image_evidence":' || (ni > 0) || ',"has_relation_trace":' || (nr > 0) || ',"weaknesses":[' || concat_ws(',', {", ".join(f"CASE WHEN {n} = 0 THEN chr(34) || '{m}' || chr(34) END" for n, m in WEAK)}) || ']}}' AS coverage_notes FROM a""",
    "model_contexts": f"""
        WITH {ANSWERED} SELECT query_id, CASE WHEN query_id % 3 = 2 THEN 'extractive' ELSE 'model' END AS mode, CAST(nt AS INTEGER) AS texts, CAST(nr AS INTEGER) AS relations, CAST(nt + ni AS INTEGER) AS "references" FROM a""",
    "compression_sizes": f"""
        WITH {DOCS}, s AS (SELECT section_id, title, id, concept_id, coalesce(source_file, '') AS source_file, content FROM d),
        z AS (SELECT section_id AS query_id, {json_size("'query_id': section_id", "'query': title", "'text_blocks': [{'id': id, 'title': title, 'concept_id': concept_id, 'source_file': source_file, 'content': content}]")} AS retrieval_size,
              {json_size("'query': title", f"""'compact_context': {{'key_text_evidence': [{{'id': id, 'title': title, 'concept_id': concept_id, 'source_file': source_file, 'excerpt': {excerpt("content")}, 'citation': {CITED}}}], 'key_image_evidence': [], 'key_relations': [],
              'source_references': [{{{", ".join(REFERRED)}}}], 'coverage_notes': {{'has_text_evidence': TRUE, 'has_image_evidence': FALSE, 'has_relation_trace': FALSE, 'weaknesses': ['{WEAK[1][1]}', '{WEAK[2][1]}']}}}}""")} AS compressed_size FROM s)
        SELECT query_id, CAST(retrieval_size AS INTEGER) AS retrieval_size, CAST(compressed_size AS INTEGER) AS compressed_size, compressed_size < retrieval_size AS compressed_smaller FROM z""",
    "answer_checks": f"""
        WITH {ANSWERED}, {SIZES}, f AS (SELECT a.query_id, coalesce(wb.small, 0) + coalesce(wr.small, 0) + {NOTE_SIZE} < coalesce(wb.whole, 0) + coalesce(wr.whole, 0) + coalesce(wt.whole, 0) AS smaller, nt + ni AS found FROM a LEFT JOIN wb USING (query_id) LEFT JOIN wr USING (query_id) LEFT JOIN wt USING (query_id))
        SELECT query_id, smaller AS compressed_smaller, found > 0 AS has_evidence, CAST(found AS INTEGER) AS citations, smaller AND found > 0 AS passed FROM f""",
    "retrieval_checks": f"""
        WITH {TITLES} SELECT query_id, CAST(nt AS INTEGER) AS text_blocks, CAST(ni AS INTEGER) AS image_blocks, CAST(nr AS INTEGER) AS relation_blocks, CAST(deepest AS INTEGER) AS max_seen_hop, failed = '' AS quality_ok, {PASSED} AND failed = '' AS passed, failed FROM g""",
    "page_section_tree": f"WITH {TREE} SELECT source_file, pos, level, title, section_id, parent_pos, parent_title, breadcrumb, child_titles, content FROM tree",
    "page_text_chunks": f"""
        WITH {TREE}, w AS (SELECT *, {clean("title || chr(10) || content")} AS whole FROM tree WHERE level = 1 AND content <> '')
        SELECT {stable("source_file", "section_id", "title", "whole")} AS id, whole AS content, title, parent_title, {slug("title")} AS concept_id, section_id, source_file, level, length(whole) AS content_length,
               CASE WHEN {contains_any("lower(title || ' ' || whole)", CFG.risk_terms)} THEN 'risk' WHEN {contains_any("lower(title || ' ' || whole)", CFG.procedure_terms)} THEN 'procedure' ELSE 'concept' END AS type FROM w""",
    "page_markup_sections": f"""
        WITH {PAGES}, x AS (SELECT *, CASE WHEN heading = '' THEN title ELSE heading END AS parent_title FROM pg),
        y AS (SELECT *, 'Parts' AS part, 'part ' || page_id || ' inner ' || page_id || ' inner ' || page_id || ' page | ' || page_id || ' ; cell' AS content FROM x UNION ALL SELECT *, 'Made', 'inside ' || page_id FROM x)
        SELECT source_file, part AS title, 'page-' || page_id || '-' || lower(part) || CASE WHEN {slug("heading", "section")} = lower(part) THEN '-2' ELSE '' END AS section_id, parent_title, content FROM y""",
    "page_image_chunks": f"""
        WITH {DIAGRAMS} SELECT image_id, {clean("'Diagram under: Map. Caption: ' || caption || '. Visible labels: ' || replace(labels, '|', '; ') || '. Context: ' || coalesce(nullif(parent_title, ''), 'root') || ' / ' || source_file || '.'")} AS description,
               'Map' AS title, 'map' AS concept_id, section_id, source_file, 'svg' AS type, caption, labels, substring({clean("raw")}, 1, 500) AS raw FROM gi""",
    "page_svg_assets": f"WITH {DIAGRAMS} SELECT image_id, raw AS svg, '/images/' || image_id || '.svg' AS asset_url FROM gi",
    "module_bundle_items": f"""
        WITH {DOCS}, {IMAGES}, {DOC_EDGES}
        SELECT source_file, 'text_chunks' AS part, id, title FROM d UNION ALL SELECT source_file, 'image_chunks', image_id, title FROM i
        UNION ALL SELECT DISTINCT source_file, 'relations', relation_id, '' FROM own JOIN x ON concept_id = source_id OR concept_id = target_id UNION ALL SELECT source_file, 'concepts', concept_id, '' FROM own""",
}
