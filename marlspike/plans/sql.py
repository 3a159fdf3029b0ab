"""ANSI SQL twins of the queries, for a run on the same Parquet tables in DuckDB."""

from __future__ import annotations

from ..functions.text import DEFAULT_HEADING, HEADING_OPENINGS, LINE_BREAK, SPACE, STOP_WORDS

PAGES = "(SELECT DISTINCT * FROM raw_docs)"
REPORTS = "(SELECT DISTINCT * FROM reports)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def clean(x: str) -> str:
    joined = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\x00', '', 'g'), '-(\\r\\n|\\n|\\r){SPACE}*([a-z])', '\\2', 'g')"
    lines = f"list_transform(regexp_split_to_array({joined}, '{LINE_BREAK}'), lambda l: {strip('l')})"
    kept = f"list_filter({lines}, lambda l: l <> '' AND NOT regexp_matches(l, '^\\p{{Nd}}{{1,4}}$'))"
    return strip(f"regexp_replace(array_to_string({kept}, ' '), '[ \\t]+', ' ', 'g')")


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def terms(x: str) -> str:
    stop = ", ".join(map(_q, STOP_WORDS))
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({stop}))"


def tail(x: str, n: int) -> str:
    return f"CASE WHEN len({words(x)}) >= {n} THEN array_to_string(list_slice({words(x)}, -{n}, -1), ' ') ELSE {x} END"


STITCHED = f"""SELECT raw_id, source, seq, CASE WHEN length(coalesce(t, '')) > 0 THEN t || chr(10) || b ELSE b END AS stitched FROM (
  SELECT raw_id, source, seq, b, lag({tail('b', 40)}) OVER (PARTITION BY source ORDER BY seq, raw_id) AS t
  FROM (SELECT raw_id, source, seq, coalesce(page_content, '') AS b FROM {PAGES}))"""

_H = "regexp_replace(c, '^[*#\\- \\t]+|[*#\\- \\t]+$', '', 'g')"
HEADING = (
    f"CASE WHEN length(c) < 100 AND NOT contains(c, chr(10)) AND ((regexp_matches({_H}, '\\p{{Lu}}') AND NOT regexp_matches({_H}, '\\p{{Ll}}') AND length({_H}) > 4)"
    f" OR regexp_matches(lower({_H}), '^({'|'.join(HEADING_OPENINGS)})')) THEN {_H} END"
)
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, uid ORDER BY coalesce(len(messages), -1) DESC) AS rn FROM conversations) WHERE rn = 1)"


def role(x: str) -> str:
    r = f"lower(trim(coalesce({x}, '')))"
    return f"CASE WHEN {r} IN ('user', 'human') THEN 'user' WHEN {r} IN ('assistant', 'ai', 'bot') THEN 'assistant' ELSE {r} END"


def attribute(name: str) -> str:
    return f"list_filter(attributes, lambda a: a.name = '{name}')[-1].value"


USERS = f"""(SELECT DISTINCT username AS id, userstatus AS status, usercreatedate AS joined, {attribute('sub')} AS sub, coalesce({attribute('email')}, '') AS email,
  coalesce({attribute('custom:role')}, 'user') AS role, coalesce(nullif({attribute('name')}, ''), split_part(coalesce({attribute('email')}, ''), '@', 1)) AS username, {attribute('custom:data_consent')} AS consent FROM users)"""


def moment(x: str) -> str:
    return f"try_cast(nullif(trim({x}), '') AS TIMESTAMPTZ)"


TF = f"""(SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {terms('text')} AS t FROM documents)) GROUP BY 1, 2)"""
SPARSE = f"""tf AS MATERIALIZED {TF}, stats AS (SELECT count(*) AS n_docs, avg(len({terms('text')})) AS avgdl FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT item_id AS qkey, unnest(list_distinct({terms('question')})) AS term FROM eval_items),
idf AS (SELECT qkey, term, ln((n_docs + 1) / (coalesce(df, 1) + 0.5)) AS idf FROM asked LEFT JOIN df USING (term), stats),
w AS (SELECT qkey, term, idf / sum(idf) OVER (PARTITION BY qkey) AS qw FROM idf),
scored AS (SELECT qkey, doc_id AS key, round(sum(qw * (tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avgdl)))), 6) AS score FROM w JOIN tf USING (term), stats GROUP BY 1, 2),
sparse AS (SELECT qkey, key, score, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, key) AS rank FROM scored)"""


def dense(asked: str) -> str:
    return f"""dscored AS (SELECT q.qkey, v.vec_id AS key, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM ({asked}) q, embeddings v),
dense AS (SELECT qkey, key, score, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, key) AS rank FROM dscored)"""


ASKED = "SELECT item_id AS qkey, embedding FROM eval_items JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings)"
FUSED = f"""WITH {SPARSE}, {dense(ASKED)},
parts AS (SELECT qkey, key, CAST(0.4 AS DOUBLE) / (rank + 60) AS part FROM sparse WHERE rank <= 10 UNION ALL SELECT qkey, key, CAST(0.6 AS DOUBLE) / (rank + 60) FROM dense WHERE rank <= 10),
summed AS (SELECT qkey, key, round(sum(part), 9) AS score FROM parts GROUP BY 1, 2),
fused AS (SELECT qkey, key, score, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, key) AS rank FROM summed)"""

_MARKED = f"regexp_replace({strip('text')}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g')"
_SENT = f"list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
#: packing as a fold: ``start`` is the first part of the open chunk, prefix sums tell when it is full and where the overlap begins
PACKED = f"""WITH RECURSIVE pages AS MATERIALIZED (SELECT p.raw_id, p.source, p.page, x.c, x.header FROM {PAGES} p JOIN (
  SELECT raw_id, c, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq, raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '{DEFAULT_HEADING}') AS header
  FROM (SELECT raw_id, source, seq, c, {HEADING} AS own FROM (SELECT raw_id, source, seq, {clean('stitched')} AS c FROM ({STITCHED}))) WHERE c <> '') x USING (raw_id)),
long AS MATERIALIZED (SELECT raw_id, {_SENT.replace('text', 'c')} AS s FROM pages WHERE length({strip('c')}) // 4 > 1000),
said AS (SELECT raw_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM long),
part AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY raw_id ORDER BY i)::BIGINT AS upto FROM (SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY grp) AS i, t, greatest(1, length(t) // 4) AS n FROM (
  SELECT raw_id, grp, string_agg(s, ' ' ORDER BY k) AS t FROM (SELECT *, sum(CASE WHEN k = 1 OR len({words('s')}) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY k) AS grp FROM said) GROUP BY 1, 2))),
back AS MATERIALIZED (SELECT a.raw_id, a.i, a.n, a.upto, max(b.i) AS j FROM part a LEFT JOIN part b ON b.raw_id = a.raw_id AND b.i < a.i AND (a.upto - a.n) - (b.upto - b.n) >= 150 GROUP BY ALL),
fold AS (SELECT raw_id, 1::BIGINT AS i, 1::BIGINT AS start, NULL::BIGINT AS e1, NULL::BIGINT AS e2 FROM long
  UNION ALL SELECT raw_id, i + 1, CASE WHEN full_ THEN greatest(start, coalesce(j, start)) ELSE start END, CASE WHEN full_ THEN start END, CASE WHEN full_ THEN i - 1 END
  FROM (SELECT f.raw_id, f.i, f.start, b.j, b.upto - (s.upto - s.n) > 1000 AND f.i > f.start AS full_ FROM fold f JOIN back b ON b.raw_id = f.raw_id AND b.i = f.i JOIN part s ON s.raw_id = f.raw_id AND s.i = f.start)),
spans AS (SELECT raw_id, e1, e2 FROM fold WHERE e1 IS NOT NULL UNION ALL SELECT raw_id, start, i - 1 FROM (SELECT *, max(i) OVER (PARTITION BY raw_id) AS m FROM fold) WHERE i = m),
bodies AS (SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY e2) - 1 AS chunk_index, body FROM (SELECT s.raw_id, s.e2, string_agg(p.t, ' ' ORDER BY p.i) AS body FROM spans s JOIN part p ON p.raw_id = s.raw_id AND p.i BETWEEN s.e1 AND s.e2 GROUP BY s.raw_id, s.e1, s.e2)
  UNION ALL SELECT raw_id, 0, c FROM pages WHERE raw_id NOT IN (SELECT raw_id FROM long)),
texts AS (SELECT raw_id, source, page, header, chunk_index, '[SECTION: ' || header || ']' || chr(10) || body AS text FROM bodies JOIN pages USING (raw_id)),
kept AS (SELECT *, {strip('text')} AS t FROM texts)
SELECT sha256(coalesce(source, '') || '|' || coalesce(page, 0)::VARCHAR || '|' || chunk_index || '|' || text) AS chunk_id, min(raw_id) AS raw_id, source, coalesce(page, 0)::BIGINT AS page, header, chunk_index, text FROM kept
WHERE NOT (length(t) < 40 OR {letters('t')}::DOUBLE / greatest(length(t), 1) < 0.35 OR (len(list_distinct({words('lower(t)')})) <= 5 AND length(t) > 300)) GROUP BY ALL"""
_MARKS = "page, least(greatest(floor(l_quantity / 6.0), 0), 9)::BIGINT AS bucket"


def hist(where: str = "true") -> str:
    return f"""SELECT p.page, b.bucket, count(m.bucket) AS n FROM (SELECT DISTINCT l_suppkey AS page FROM lineitem WHERE {where}) p CROSS JOIN (SELECT range AS bucket FROM range(10)) b
LEFT JOIN (SELECT l_suppkey AS page, least(greatest(floor(l_quantity / 6.0), 0), 9)::BIGINT AS bucket FROM lineitem WHERE {where}) m ON m.page = p.page AND m.bucket = b.bucket GROUP BY 1, 2"""


_THIN = "not (l_quantity between 12 and 17) and not (l_quantity between 36 and 41)"
GAPS = f"""SELECT page, min(bucket) AS start, max(bucket) + 1 AS stop FROM (SELECT page, bucket, bucket - row_number() OVER (PARTITION BY page ORDER BY bucket) AS run
FROM (SELECT *, max(n) OVER (PARTITION BY page) AS peak FROM ({hist(_THIN)})) WHERE n <= peak * 0.15) GROUP BY page, run HAVING min(bucket) > 1 AND max(bucket) + 1 < 9"""

ORACLES: dict[str, str] = {
    "projected_scan": "SELECT DISTINCT conv_id, uid, title FROM conversations",
    "filtered_scan": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 1000",
    "count_scan": "SELECT 'users' AS tab, count(DISTINCT username) AS n FROM users UNION ALL SELECT 'conversations', count(DISTINCT (conv_id, uid)) FROM conversations UNION ALL SELECT 'raw_docs', count(DISTINCT raw_id) FROM raw_docs",
    "key_lookup": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7",
    "index_query_desc": f"SELECT uid, conv_id, epoch_us({moment('created_at')}) AS created FROM {LATEST} WHERE uid = (SELECT uid FROM {LATEST} GROUP BY uid ORDER BY count(*) DESC, uid LIMIT 1)",
    "format_dispatch": "SELECT DISTINCT source, CASE WHEN e IN ('pdf', 'docx', 'txt', 'md', 'csv') THEN e ELSE 'skip' END AS reader FROM (SELECT source, lower(regexp_extract(source, '\\.([^./\\\\]+)$', 1)) AS e FROM raw_docs)",
    "clean_text": f"SELECT raw_id, {clean('page_content')} AS cleaned FROM {PAGES}",
    "text_quality": f"""SELECT raw_id, chars, words, alpha_ratio, chars < 180 OR words < 40 OR a < 0.12 AS needs_recognition FROM (SELECT raw_id, length(t)::BIGINT AS chars, len(regexp_extract_all(t, '[A-Za-z0-9]+'))::BIGINT AS words,
        CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE {letters('t')}::DOUBLE / length(t) END AS a, round(CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE {letters('t')}::DOUBLE / length(t) END, 6) AS alpha_ratio
        FROM (SELECT raw_id, {strip("coalesce(page_content, '')")} AS t FROM {PAGES}))""",
    "low_value_filter": f"SELECT raw_id FROM (SELECT raw_id, {strip("coalesce(page_content, '')")} AS t FROM {PAGES}) WHERE length(t) < 40 OR {letters('t')}::DOUBLE / greatest(length(t), 1) < 0.35 OR (len(list_distinct({words('lower(t)')})) <= 5 AND length(t) > 300)",
    "approx_tokens": f"SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 4) END::BIGINT AS tokens FROM (SELECT doc_id, length({strip("coalesce(text, '')")}) AS n FROM documents)",
    "sentence_split": f"""SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_sentences, coalesce(g.s, '') AS sentences FROM documents d LEFT JOIN (
        SELECT doc_id, count(*) AS n, string_agg(m, '¶' ORDER BY grp) AS s FROM (SELECT doc_id, grp, string_agg(s, ' ' ORDER BY i) AS m FROM (
        SELECT doc_id, s, i, sum(CASE WHEN i = 1 OR len({words('s')}) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp
        FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_SENT} AS x FROM documents WHERE text IS NOT NULL))) GROUP BY 1, 2) GROUP BY 1) g USING (doc_id)""",
    "page_stitch": f"SELECT raw_id, stitched FROM ({STITCHED})",
    "header_propagate": f"SELECT raw_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq, raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '{DEFAULT_HEADING}') AS header FROM (SELECT raw_id, source, seq, {HEADING} AS own FROM (SELECT raw_id, source, seq, {clean('stitched')} AS c FROM ({STITCHED})))",
    "chunk_pack": PACKED,
    "chunk_id_dedup": f"SELECT chunk_id, min(raw_id) AS raw_id FROM (SELECT raw_id, sha256(coalesce(source, '') || '|' || coalesce(page, 0)::VARCHAR || '|0|' || {clean('page_content')}) AS chunk_id FROM {PAGES}) GROUP BY 1",
    "metadata_sanitise": f"SELECT raw_id, array_to_string(list_filter([CASE WHEN page_content IS NULL OR length(page_content) <= 2048 THEN 'body' END, CASE WHEN section_heading IS NULL OR length(section_heading) <= 2048 THEN 'heading' END, CASE WHEN source IS NULL OR length(source) <= 2048 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS kept FROM {PAGES}",
    "template_fill": "SELECT s_suppkey, 'January 01, 2026: ' || s_name || ' (' || s_suppkey || ') has ' AS filled FROM supplier",
    "padded_report": "SELECT n_nationkey, n_name || repeat(' ', greatest(0, 12 - length(n_name))) || repeat(' ', greatest(0, 6 - length(n_regionkey::VARCHAR))) || n_regionkey::VARCHAR AS line FROM nation",
    "display_text": f"SELECT report_id, CASE WHEN length(msg_snippet) > 70 THEN left(msg_snippet, 70) || '…' ELSE msg_snippet END AS snippet, upper(left(trim(status), 1)) || lower(substr(trim(status), 2)) AS status, replace(replace(other_text, '<', '&lt;'), '>', '&gt;') AS other FROM {REPORTS}",
    "citation_rank": f"""SELECT raw_id, number, file, pages FROM (SELECT raw_id, unnest([1, 2])::BIGINT AS number, unnest([source, 'manual.pdf']) AS file,
        unnest([array_to_string(list_sort(list_distinct([coalesce(page, 0)::VARCHAR, '7', '3'])), ','), '']) AS pages FROM {PAGES} WHERE source <> 'manual.pdf')""",
    "password_marks": f"SELECT p_partkey, CASE WHEN m < 2 THEN 'Weak' WHEN m < 4 THEN 'Medium' ELSE 'Strong' END AS strength FROM (SELECT p_partkey, (length(x) >= 8)::INT + regexp_matches(x, '[a-z]')::INT + regexp_matches(x, '[A-Z]')::INT + regexp_matches(x, '[0-9]')::INT + regexp_matches(x, '[!@#$%^&*(),.?\":{{}}|<>]')::INT AS m FROM (SELECT p_partkey, p_brand || '-' || p_size AS x FROM part))",
    "bm25_fit": f"SELECT term, count(*) AS df FROM {TF} GROUP BY 1",
    "bm25_stats": f"SELECT count(*) AS n_docs, round(avg(len({terms('text')})), 6) AS avgdl FROM documents",
    "bm25_topk": f"WITH {SPARSE} SELECT * FROM sparse WHERE rank <= 10",
    "dense_topk": f"WITH {dense('SELECT vec_id AS qkey, embedding FROM embeddings WHERE vec_id % 50 = 0')} SELECT * FROM dense WHERE rank <= 10",
    "rrf_fusion": f"{FUSED} SELECT * FROM fused",
    "rerank_top5": f"{FUSED} SELECT qkey, key, rank FROM fused WHERE rank <= 5",
    "context_blocks": f"""WITH {SPARSE} SELECT a.qkey, coalesce(c.context, 'No relevant context found.') AS context FROM (SELECT item_id AS qkey FROM eval_items UNION SELECT -1) a LEFT JOIN (SELECT qkey, string_agg('[DOCUMENT ' || rank || ']' || CASE WHEN source IS NULL THEN '' WHEN contains(lower(source), 'library') THEN '' ELSE ' [UPDATE]' END || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || ' | Page: ?' || chr(10) || 'Content:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
        FROM sparse JOIN documents ON doc_id = key WHERE rank <= 5 GROUP BY 1) c USING (qkey)""",
    "upsert_latest": "SELECT conv_id, uid, max(len(messages))::BIGINT AS n_messages FROM conversations GROUP BY 1, 2",
    "keyed_upsert": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "conditional_update": f"SELECT report_id, CASE WHEN lower(status) = 'pending' THEN 'done' ELSE status END AS status, CASE WHEN lower(status) = 'pending' THEN '2026-01-01T00:00:00Z' ELSE resolved_at END AS resolved_at FROM {REPORTS}",
    "keyed_delete": "SELECT filename, uploaded_by FROM files WHERE NOT EXISTS (SELECT 1 FROM raw_docs WHERE page IS NULL AND source = filename)",
    "cascade_delete": f"SELECT DISTINCT conv_id, uid FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM {USERS} u WHERE u.status = 'UNCONFIRMED' AND u.sub = c.uid)",
    "predicate_delete": f"SELECT raw_id, source FROM {PAGES} WHERE NOT coalesce(lower(source) LIKE '%.csv', false)",
    "stale_cleanup": f"SELECT id, nullif(email, '') AS email FROM {USERS} u WHERE nullif(email, '') IS NULL OR NOT EXISTS (SELECT 1 FROM {USERS} c WHERE c.status = 'CONFIRMED' AND c.email = u.email) OR EXISTS (SELECT 1 FROM {USERS} c WHERE c.status = 'CONFIRMED' AND c.email = u.email AND c.id = u.id)",
    "status_counts": f"SELECT lower(trim(coalesce(status, 'none'))) AS status, count(*) AS n FROM {REPORTS} GROUP BY 1",
    "status_list": f"SELECT report_id, epoch_us({moment('created_at')}) AS created FROM {REPORTS} WHERE lower(status) = 'pending'",
    "activity_feed": f"""SELECT icon, epoch_us(ts) AS ts, description FROM (SELECT 'upload' AS icon, {moment('uploaded_at')} AS ts, 'New document uploaded: ' || coalesce(filename, 'N/A') AS description FROM files
        UNION SELECT 'chat', {moment('created_at')}, 'New conversation started: ' || coalesce(title, 'Untitled') FROM {LATEST} UNION SELECT 'user', joined, 'New user registered: ' || username FROM {USERS}) ORDER BY ts DESC NULLS LAST, icon, description LIMIT 5""",
    "eav_pivot": f"SELECT id, status, sub, email, role, username FROM {USERS}",
    "consent_mask": f"SELECT id, username, CASE WHEN coalesce(consent = 'false', false) THEN 'not shared' ELSE email END AS email FROM {USERS}",
    "relative_time": f"""SELECT id, CASE WHEN s IS NULL OR s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ago'
        ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END || ' ago' END AS ago FROM (SELECT id, 1767225600 - floor(epoch(joined))::BIGINT AS s FROM {USERS})""",
    "user_lookup_fallback": f"""SELECT report_id, coalesce(a.id, b.id) AS id FROM {REPORTS} r LEFT JOIN (SELECT sub, min(id) AS id FROM {USERS} WHERE sub IS NOT NULL GROUP BY 1) a ON a.sub = r.reporter_uid
        LEFT JOIN (SELECT email, min(id) AS id FROM {USERS} WHERE email <> '' GROUP BY 1) b ON b.email = r.reporter_email""",
    "report_cutoff": f"""SELECT report_id, coalesce(len(messages), -1)::BIGINT AS n_messages, CASE WHEN messages IS NULL THEN -1 ELSE coalesce(list_max(list_transform(messages, lambda m, i: CASE WHEN {role('m.role')} = 'assistant' AND h <> '' AND contains(coalesce(m.content, ''), h) THEN i END)), len(messages)) END::BIGINT AS cut
        FROM (SELECT r.report_id, c.messages, left({strip("coalesce(r.msg_snippet, '')")}, 50) AS h FROM {REPORTS} r LEFT JOIN {LATEST} c ON c.conv_id = r.conv_id AND c.uid = r.reporter_uid)""",
    "distinct_sources": "SELECT source, min(seq)::BIGINT AS first_seq, count(DISTINCT raw_id) AS n FROM raw_docs GROUP BY 1",
    "missing_uploads": "SELECT DISTINCT source AS filename FROM raw_docs WHERE NOT EXISTS (SELECT 1 FROM files WHERE filename = source AND uploaded_by IS NOT NULL)",
    "existence_flags": "SELECT DISTINCT username, len(list_filter(attributes, lambda a: a.name = 'email')) > 0 AS has_email, len(attributes)::BIGINT AS n FROM users",
    "code_lookup": "SELECT n_nationkey, coalesce(r_name, 'other') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey",
    "positional_zip": "SELECT p_partkey, unnest([0, 1, 2])::BIGINT AS pos, unnest(['name', 'brand', 'type']) AS k, unnest([p_name, p_brand, p_type]) AS v FROM part",
    "weighted_mean": "SELECT l_suppkey, coalesce(round_even(sum(CASE WHEN l_returnflag = 'N' THEN l_discount * l_quantity END) / nullif(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0), 2), 0.0) AS mean, coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS weight FROM lineitem GROUP BY 1",
    "yearly_rollup": "SELECT o_custkey, year(o_orderdate)::BIGINT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    "grouped_members": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS members FROM nation GROUP BY 1",
    "history_last6": f"SELECT conv_id, pos, {role('m.role')} AS role, m.content AS content FROM (SELECT conv_id, unnest(x) AS m, (generate_subscripts(x, 1) - 1)::BIGINT AS pos FROM (SELECT conv_id, list_slice(messages, -6, -1) AS x FROM {LATEST}))",
    "history_compaction": f"""SELECT conv_id, CASE WHEN len(messages) > 10 THEN 7 ELSE len(messages) END::BIGINT AS n, CASE WHEN len(messages) > 10 THEN 'Previous conversation summary: ' || array_to_string(list_transform(list_slice(messages, 1, len(messages) - 6), lambda m: {role('m.role')} || ': ' || coalesce(m.content, '')), chr(10))
        ELSE coalesce(messages[1].content, '') END AS first_content FROM {LATEST} WHERE messages IS NOT NULL""",
    "visible_messages": f"SELECT conv_id, coalesce(len(list_filter(messages, lambda m: {role('m.role')} <> 'system')), 0)::BIGINT AS n FROM {LATEST}",
    "conv_title": f"SELECT conv_id, coalesce(left(list_filter(messages, lambda m: {role('m.role')} = 'user')[1].content, 40), 'Untitled Chat') AS derived FROM {LATEST}",
    "transcript": f"SELECT conv_id, array_to_string(list_transform(messages, lambda m: {role('m.role')} || ': ' || coalesce(m.content, '')), chr(10)) AS text FROM {LATEST} WHERE messages IS NOT NULL",
    "column_histogram": hist(),
    "gap_islands": GAPS,
    "page_columns": f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY l) AS "column", l AS "left", r AS "right" FROM (SELECT page, unnest(list_concat([0.0::DOUBLE], m)) AS l, unnest(list_concat(m, [10.0::DOUBLE])) AS r FROM (
        SELECT p.page, coalesce(m, []) AS m FROM (SELECT DISTINCT l_suppkey AS page FROM lineitem WHERE {_THIN}) p LEFT JOIN (SELECT page, list((start + stop) / 2.0::DOUBLE ORDER BY start) AS m FROM ({GAPS}) WHERE page % 5 <> 0 GROUP BY 1) USING (page)))""",
    "heading_sections": f"SELECT raw_id, sum(CASE WHEN coalesce(trim(section_heading), '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq, raw_id)::BIGINT AS section FROM {PAGES} WHERE type = 'docx_section'",
    "rolling_context": "SELECT o_orderkey, string_agg(o_orderpriority, chr(10)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context FROM orders",
    "merged_cells": "SELECT n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'region ' || n_regionkey ELSE '' END AS cell FROM nation",
    "table_markdown": """SELECT n_regionkey, string_agg(l || CASE WHEN rn = 1 THEN chr(10) || CASE WHEN w = 2 THEN '| --- | --- |' ELSE '| --- |' END ELSE '' END, chr(10) ORDER BY n_nationkey) AS markdown FROM (
        SELECT *, '| ' || n_name || CASE WHEN k = 2 THEN ' | ' || n_nationkey WHEN w = 2 THEN ' | ' ELSE '' END || ' |' AS l FROM (
        SELECT *, max(k) OVER (PARTITION BY n_regionkey) AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END AS k FROM nation))) GROUP BY 1""",
    "known_reporters": f"SELECT DISTINCT report_id, reporter_uid FROM reports WHERE EXISTS (SELECT 1 FROM {USERS} u WHERE u.sub = reporter_uid)",
    "running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders",
    "top_per_group": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "longest_recent_word": f"""SELECT d.doc_id, w AS word FROM documents d LEFT JOIN (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) AS rn FROM (
        SELECT doc_id, regexp_replace(unnest(x), '[^A-Za-z0-9_-]', '', 'g') AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_slice({words("coalesce(text, '')")}, -8, -1) AS x FROM documents)) WHERE length(w) > 3 AND try_cast(w AS DOUBLE) IS NULL) g ON g.doc_id = d.doc_id AND rn = 1""",
    "url_encoded": "SELECT DISTINCT filename, replace(url_encode(filename), '%20', '+') AS encoded FROM files",
    "date_display": "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS shown FROM orders",
    "base64_text": "SELECT n_nationkey, base64(encode(n_name)) AS b FROM nation",
    "session_events": """SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "history_merge": f"""SELECT conv_id, role, count(*) AS n FROM (SELECT conv_id, {role('m.role')} AS role FROM (SELECT conv_id, unnest(messages) AS m FROM {LATEST})
        UNION ALL SELECT conv_id, unnest(['user', 'assistant']) FROM {LATEST}) GROUP BY 1, 2""",
    "server_events": """SELECT 'data: {"type":"chunk","text":"' || r_name || '"}' || chr(10) || chr(10) AS line FROM region""",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_windows": """SELECT start, event_type, n, value FROM (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)
        WHERE start + 300000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""",
    "row_text": "SELECT s_suppkey, 'Row: ' || s_name || ' | ' || s_nationkey || CASE WHEN s_nationkey > 9 THEN ' | x' ELSE '' END AS line FROM supplier",
    "event_lines": "SELECT CASE r_regionkey WHEN 0 THEN 'error' WHEN 1 THEN 'done' ELSE 'chunk' END AS type, r_name AS text, CASE WHEN r_regionkey = 1 THEN 'c1' END AS conv_id FROM region",
    "relative_time_text": f"""SELECT filename, uploaded_at, CASE WHEN uploaded_at IS NULL OR uploaded_at = '' THEN 'just now' WHEN s IS NULL THEN 'a while ago' ELSE CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ago' ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END || ' ago' END END AS ago
        FROM (SELECT DISTINCT filename, uploaded_at, 1767225600 - floor(epoch({moment('uploaded_at')}))::BIGINT AS s FROM files)""",
    "rolling_sections": f"""SELECT raw_id, string_agg(head, chr(10)) OVER (PARTITION BY source, section ORDER BY seq, raw_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context FROM (
        SELECT raw_id, source, seq, left(coalesce(page_content, ''), 20) AS head, sum(CASE WHEN coalesce(trim(section_heading), '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq, raw_id) AS section FROM {PAGES} WHERE type = 'docx_section')""",
    "users_by_joined": f"SELECT id, epoch_us(joined) AS joined FROM {USERS} WHERE joined IS NOT NULL ORDER BY joined DESC, id",
    "customers_by_name": "SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey",
    "file_list": "SELECT DISTINCT filename AS name, 0::BIGINT AS size FROM files WHERE filename IS NOT NULL",
    "log_snippets": "SELECT doc_id, left(replace(text, chr(10), ' '), 80) AS snippet FROM documents",
    "kilobytes": "SELECT doc_id, printf('%.1f', floor(coalesce(n_chars, 0) / 1024.0::DOUBLE * 10 + 0.5) / 10) AS kb FROM documents",
    "html_titles": "SELECT n_nationkey, CASE WHEN n_nationkey > 3 THEN n_name || chr(10) END AS title FROM nation",
    "paragraph_split": f"""SELECT doc_id, len(p)::BIGINT AS n, array_to_string(p, '¶') AS paragraphs FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\n+'), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM documents)""",
    "iso_times": "SELECT doc_id, strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS published FROM documents WHERE published_at IS NOT NULL",
    "thousands": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE format('{:,}', c_custkey * 7919) END AS shown FROM customer",
    "allowed_states": f"SELECT report_id, coalesce(lower(trim(status)) IN ('done', 'ignored'), false) AS allowed FROM {REPORTS}",
    "usable_names": "SELECT DISTINCT username, coalesce(length(trim(username)) >= 3 AND NOT regexp_matches(username, '[@\\s]'), false) AS usable, false AS short FROM users",
    "delete_everywhere": f"""WITH gone AS (SELECT source FROM raw_docs GROUP BY 1 HAVING count(DISTINCT raw_id) > 20) SELECT 'pages' AS tab, count(*) AS n FROM {PAGES} WHERE source IS NULL OR source NOT IN (SELECT source FROM gone WHERE source IS NOT NULL)
        UNION ALL SELECT 'files', count(*) FROM files WHERE filename NOT IN (SELECT source FROM gone WHERE source IS NOT NULL)""",
    "attribute_update": f"SELECT DISTINCT id, CASE WHEN status = 'UNCONFIRMED' THEN 'guest' ELSE role END AS role FROM {USERS}",
    "identity_rewrite": f"SELECT report_id, u.sub AS reporter_uid FROM {REPORTS} r JOIN (SELECT email, min(sub) AS sub FROM {USERS} WHERE email <> '' GROUP BY 1) u ON u.email = r.reporter_email",
    "first_row_header": "SELECT n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'Nations: ' ELSE '  ' END || n_name AS line FROM nation",
    "model_messages": f"""SELECT conv_id, 'system=Be brief.' || coalesce(array_to_string(list_transform(messages, lambda m: '|' || {role('m.role')} || '=' || coalesce(m.content, '')), ''), '') || '|user=' || coalesce(title, '?') AS said,
        coalesce(title, '?') || CASE WHEN length(conv_id) % 2 = 0 THEN ' [Image Uploaded]' ELSE '' END AS marked, coalesce(title, '?') AS bare FROM {LATEST}""",
    "vector_norms": "SELECT vec_id, round(v[1] / n, 6) AS first, 1.0::DOUBLE AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "embedded_texts": "SELECT item_id, round(a / n, 6) AS x, round(b / n, 6) AS y, round(c / n, 6) AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT item_id, length(question)::DOUBLE AS a, length(question)::DOUBLE - length(replace(question, 'e', '')) AS b, length(question)::DOUBLE - length(replace(question, ' ', '')) AS c FROM eval_items))",
    "reranked_by_model": f"""WITH {SPARSE} SELECT qkey, key, r AS rank FROM (SELECT qkey, key, CASE WHEN length(question) % 7 = 0 THEN rank ELSE row_number() OVER (PARTITION BY qkey ORDER BY length(coalesce(text, '')) % 97 DESC, rank) END AS r FROM sparse JOIN documents ON doc_id = key JOIN eval_items ON item_id = qkey WHERE rank <= 10) WHERE r <= CASE WHEN true THEN 5 END""",
    "rewritten_queries": f"SELECT conv_id, CASE WHEN x = '' THEN title ELSE x END AS query FROM (SELECT conv_id, coalesce(title, '') AS title, trim(upper(coalesce(title, '')) || CASE WHEN coalesce(len(messages), 0) = 0 THEN ' *' ELSE '' END) AS x FROM {LATEST})",
    "extracted_records": "SELECT item_id, CASE WHEN length(question) % 5 = 0 THEN -1 ELSE length(question) END::BIGINT AS n, CASE WHEN length(question) % 5 = 0 THEN 'none' ELSE 'q' END AS kind FROM eval_items",
    "recognised": "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN '' ELSE reverse(n_name) END AS text FROM nation",
    "bm25_chunks": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest({terms('text')}) AS term FROM ({PACKED})) GROUP BY 1",
    "file_kinds": """SELECT DISTINCT source, CASE e WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'word' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'csv' THEN 'table' ELSE 'file' END AS icon,
        CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS mime
        FROM (SELECT source, lower(regexp_extract(source, '\\.([^./\\\\]+)$', 1)) AS e FROM raw_docs)""",
    "stable_choices": """SELECT c_custkey, CASE WHEN f < 1.0::DOUBLE / 3 THEN 'a' WHEN f < 2.0::DOUBLE / 3 THEN 'b' ELSE 'c' END AS even, CASE WHEN f < 0.9::DOUBLE THEN 'often' ELSE 'rarely' END AS weighted, (floor(f * 10) + 10)::BIGINT AS number, f < 0.25::DOUBLE AS sampled
        FROM (SELECT c_custkey, ('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT / 4294967296.0::DOUBLE AS f FROM customer)""",
    "local_times": "SELECT doc_id, strftime(published_at, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown FROM documents WHERE published_at IS NOT NULL",
    "inline_relation": "SELECT n_nationkey, n_name, fee::BIGINT AS fee FROM nation JOIN (VALUES (1, 10), (2, 20), (99, 30)) v(n_nationkey, fee) USING (n_nationkey)",
    "status_filter": f"SELECT report_id, 'done' AS asked FROM {REPORTS} WHERE status = 'done' UNION ALL SELECT report_id, 'all' FROM {REPORTS}",
    "user_by_address": f"SELECT email, min(sub) AS sub FROM {USERS} WHERE email = (SELECT min(reporter_email) FROM reports WHERE reporter_email <> '') GROUP BY 1",
    "page_extraction": f"""WITH a AS (SELECT raw_id, raw_id % 60 AS boxes, CASE WHEN raw_id % 7 <> 0 AND trim(coalesce(page_content, ''), ' ') <> '' THEN page_content ELSE coalesce(section_heading, '') END AS l FROM {PAGES}),
        b AS (SELECT *, {strip('l')} AS t, len(regexp_extract_all({strip('l')}, '[A-Za-z0-9]+')) AS w FROM a), c AS (SELECT *, length(t) < 180 OR w < 40 OR CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE {letters('t')}::DOUBLE / length(t) END < 0.12 AS thin FROM b),
        e AS (SELECT *, CASE WHEN boxes >= 25 AND NOT thin THEN l || chr(10) || chr(10) || 'more' ELSE l END AS x FROM c), g AS (SELECT *, {strip('x')} AS y, len(regexp_extract_all({strip('x')}, '[A-Za-z0-9]+')) AS v FROM e),
        h AS (SELECT *, boxes < 25 OR length(y) < 180 OR v < 40 OR CASE WHEN length(y) = 0 THEN 0.0::DOUBLE ELSE {letters('y')}::DOUBLE / length(y) END < 0.12 AS ocr FROM g) SELECT raw_id, length(x)::BIGINT AS n, ocr, NOT ocr AND length(y) >= 200 AS tables FROM h""",
    "table_noise": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity * l_linenumber * 5.0 < 500",
    "thread_state": "SELECT user_id::VARCHAR AS thread, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS state FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1",
}
