"""The engine's queries in SQL, for a check on the same tables. Where SQL can't say it the tests compare with brute force."""

from __future__ import annotations

from corvane.functions.text import STOP_WORDS
from corvane.operators import analysis

_PAGE = "coalesce(nullif(source_url, ''), url)"


def _key(url: str) -> str:
    bare = rf"regexp_replace({url}, '[?#].*$', '')"
    head = rf"regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)?', 1)"
    path = rf"regexp_replace(regexp_replace(substr({bare}, length({head}) + 1), ';[^/]*$', ''), '/+$', '')"
    return f"({head} || CASE WHEN {path} = '' THEN '/' ELSE {path} END)"


_LINKS = "list_filter(list_transform(coalesce(links, []), lambda x: regexp_replace(x, '#.*$', '')), lambda x: x IS NOT NULL AND x <> '')"
_ONCE = "SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id, target_url ORDER BY enriched_at IS NULL, discovered_at, id) AS n FROM link_candidates) WHERE n = 1"
_NEWEST = f"SELECT * EXCLUDE n FROM (SELECT *, {_PAGE} AS page, row_number() OVER (PARTITION BY {_PAGE} ORDER BY fetched_at DESC, content_hash DESC, url DESC) AS n FROM normalized_documents) WHERE n = 1"
_ACTIONS = f"""SELECT p.page AS source_url, p.content_hash, d.document_id,
    CASE WHEN d.document_id IS NULL THEN 'insert' WHEN d.content_hash = p.content_hash THEN 'unchanged' ELSE 'replace' END AS action
    FROM ({_NEWEST}) p LEFT JOIN indexed_documents d ON d.source_url = p.page"""
_TEXT = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]+"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{_TEXT}', 0), lambda w: length(w) > 2))"


_SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
_RICH = "(coalesce(has_table OR has_code OR has_math OR has_definition_list OR has_admonition, false) AND coalesce(html_text, '') <> '')"
_PARENTS = "(SELECT DISTINCT chunk_id, document_id, chunk_index, source_url, section_heading, title, chunk_text, html_text, has_table, has_code, has_math, has_definition_list, has_admonition, depth, token_end - token_start AS tokens FROM chunks WHERE chunk_level = 'parent')"
_HITS = """hits AS (SELECT query_id, chunk_id, least(greatest(sim, 0.0), 1.0) AS similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS n FROM (
      SELECT e.vec_id AS query_id, c.chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
      FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) e,
           (SELECT DISTINCT chunk_id, embedding FROM chunks WHERE chunk_level = 'child' AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) c) WHERE sim > 0.3) WHERE n <= 60)"""
_SCORES = f"""{_HITS}, kids AS (SELECT DISTINCT chunk_id, parent_id, depth FROM chunks WHERE chunk_level = 'child' AND parent_id IS NOT NULL),
    best AS (SELECT query_id, parent_id, score, similarity AS raw_similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, similarity DESC) AS n FROM
      (SELECT query_id, parent_id, similarity, similarity * greatest(1 - coalesce(depth, 0) * 0.05::DOUBLE, 0.80::DOUBLE) AS score FROM hits JOIN kids USING (chunk_id))) WHERE n = 1)"""
_SCORED = f"""{_SCORES}, scored AS (SELECT b.query_id, b.parent_id, round(score, 9) AS score, round(raw_similarity, 9) AS raw_similarity, p.* EXCLUDE (chunk_id)
    FROM best b JOIN {_PARENTS} p ON p.chunk_id = b.parent_id)"""


def _fit(budget: int, rows: str = "scored", key: str = "query_id", order: str = "score DESC, parent_id") -> str:
    """The walk that leaves out what overflows, row by row."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {rows}),
    walk(k, rn, used, kept, took) AS (SELECT DISTINCT {key}, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM ranked
      UNION ALL SELECT w.k, r.rn, CASE WHEN w.kept = 0 OR w.used + r.tokens <= {budget} THEN w.used + r.tokens ELSE w.used END,
        CASE WHEN w.kept = 0 OR w.used + r.tokens <= {budget} THEN w.kept + 1 ELSE w.kept END, w.kept = 0 OR w.used + r.tokens <= {budget}
      FROM walk w JOIN ranked r ON r.{key} = w.k AND r.rn = w.rn + 1),
    fitted AS (SELECT r.*, w.kept AS rank FROM ranked r JOIN walk w ON w.k = r.{key} AND w.rn = r.rn WHERE w.took)"""


_RETRIEVED = f"""{_SCORED}, {_fit(40000)},
    placed AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source_url) AS first FROM fitted),
    sourced AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS source_order FROM placed),
    retrieved AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_order, chunk_index, parent_id) AS position FROM sourced)"""
_ARRIVALS = f"""{_SCORED}, arrivals AS (SELECT CAST(query_id // 250 AS INTEGER) AS group_id,
    CAST(query_id * 100 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INTEGER) AS ord, parent_id AS chunk_id, score, source_url, section_heading, tokens, chunk_text AS selected_text FROM scored),
    united AS (SELECT group_id, min(ord) AS ord, chunk_id, max(score) AS score, any_value(tokens) AS tokens FROM arrivals GROUP BY group_id, chunk_id)"""
_SIGNALS = f"""{_SCORED}, r AS (SELECT *, row_number() OVER w AS rn, lag(score) OVER w - score AS gap, max(score) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS n FROM scored
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC)),
    s AS (SELECT query_id, max(score) AS top_score, max(CASE WHEN rn = least(n, 5) THEN score END) AS score_at_k,
      coalesce(var_samp(CASE WHEN rn <= 10 THEN score END), 0.0) AS score_variance, avg(CASE WHEN rn <= 10 THEN score END) AS score_mean,
      CAST(sum(CASE WHEN score >= CASE WHEN top > 0.03::DOUBLE THEN top - 0.03::DOUBLE ELSE 0.0 END THEN 1 ELSE 0 END) AS BIGINT) AS chunks_above_threshold,
      sum(tokens)::DOUBLE / 40000 AS token_fill_ratio, CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(CASE WHEN gap < 0.005::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / count(*) END AS redundancy_ratio,
      count(DISTINCT source_url) AS source_document_count FROM r GROUP BY query_id),
    signals AS (SELECT *, top_score - score_at_k AS score_cliff, score_variance < 0.02::DOUBLE AS is_plateau, top_score - score_at_k > 0.15::DOUBLE AS is_cliff, token_fill_ratio > 0.8::DOUBLE AS is_saturated,
      score_variance < 0.02::DOUBLE AND score_mean < 0.25::DOUBLE AS is_mediocre_plateau, redundancy_ratio > 0.85::DOUBLE AS has_high_redundancy FROM s)"""


def _analysis(table: str, key: str, q: str, suffix: str = "") -> str:
    v, p, b, t = (x.replace("'", "''") for x in (analysis.VERSUS, analysis.PROS_CONS, analysis.BOTH_FOR, analysis.TWO_QUESTIONS))
    part = lambda x, i: f"trim(regexp_extract({q}, '{x}', {i}))"
    low = f"trim(lower({q}))"
    starts = lambda *ws: "(" + " OR ".join(f"starts_with({low}, '{w}')" for w in ws) + ")"
    has = lambda *ws: "(" + " OR ".join(f"contains({low}, '{w}')" for w in ws) + ")"
    kind = f"CASE WHEN {starts('how do', 'how to', 'how can', 'how does')} THEN 'how_to' WHEN {has(' vs ', ' versus ', 'compare', 'difference between')} THEN 'comparison' WHEN {starts('what is', 'what are', 'who is', 'who are', 'when', 'where')} THEN 'factual' ELSE 'exploratory' END"
    is_ = lambda x: f"regexp_matches({q}, '{x}')"
    return f"""SELECT {key}, list_transform(subs, lambda s: s || '{suffix}') AS sub_queries, query_type, CASE WHEN len(subs) = 1 THEN 'simple' ELSE 'moderate' END AS complexity FROM (
      SELECT {key}, CASE WHEN {is_(v)} THEN [{part(v, 1)}, {part(v, 2)}] WHEN {is_(p)} THEN ['advantages of ' || {part(p, 1)}, 'disadvantages of ' || {part(p, 1)}]
        WHEN {is_(b)} THEN [{part(b, 1)} || ' for ' || {part(b, 3)}, {part(b, 2)} || ' for ' || {part(b, 3)}] WHEN {is_(t)} THEN [{part(t, 1)}, {part(t, 2)}] ELSE [{q}] END AS subs,
        CASE WHEN {is_(v)} OR {is_(p)} THEN 'comparison' WHEN {is_(b)} THEN 'exploratory' WHEN {is_(t)} THEN 'how_to' ELSE {kind} END AS query_type FROM {table} WHERE {q} IS NOT NULL)"""


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END)"


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+', 0))"


def _asked() -> str:
    from corvane.plans.queries import ASKED

    return ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED, 1))


def _concepts(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    found = rf"list_filter(regexp_extract_all(lower({c}), '\b[a-zA-Z0-9_.-]+\b', 0), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))"
    return f"list_slice(list_filter({found}, lambda w, i: list_position({found}, w) = i), 1, 6)"


_IMG = r'!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)'
_NOTES = "note|warning|important|tip|caution|danger|info|success|example|see also|deprecated since"
_URL_PATH = r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', '')"

def _walk(ceiling: float) -> str:
    """Rows of ``united`` in their order without those whose words agree with a kept row's to more than ``ceiling``."""
    words = rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(selected_text, '')), '{_SPACE}'), lambda x: x <> ''))"
    clash = f"len(s.words) > 0 AND len(list_filter(w.held, lambda k: len(list_intersect(k, s.words)) > {ceiling} * (len(k) + len(s.words) - len(list_intersect(k, s.words))))) > 0"
    return f"""steps AS (SELECT *, {words} AS words, row_number() OVER (PARTITION BY group_id ORDER BY ord, chunk_id) AS i FROM united JOIN (SELECT chunk_id, any_value(selected_text) AS selected_text FROM arrivals GROUP BY chunk_id) USING (chunk_id)),
        walk AS (SELECT group_id, i, true AS keep, list_filter([words], lambda k: len(k) > 0) AS held FROM steps WHERE i = 1
            UNION ALL SELECT s.group_id, s.i, NOT ({clash}), CASE WHEN {clash} OR len(s.words) = 0 THEN w.held ELSE list_append(w.held, s.words) END FROM walk w JOIN steps s ON s.group_id = w.group_id AND s.i = w.i + 1),
        kept AS (SELECT s.* FROM steps s JOIN walk w USING (group_id, i) WHERE w.keep)"""


SQL = {
    "s2_ingest_batch": f"""WITH r AS (SELECT fetch_id AS position, url AS requested_url, {_key('url')} AS k, row_number() OVER (PARTITION BY {_key('url')} ORDER BY fetch_id) AS turn FROM normalized_documents),
        f AS (SELECT *, {_PAGE} AS page, row_number() OVER (PARTITION BY {_PAGE} ORDER BY fetched_at DESC, fetch_id DESC) AS n FROM normalized_documents),
        p AS (SELECT url, content_hash, {_key('page')} AS k, row_number() OVER (PARTITION BY {_key('page')} ORDER BY url, fetched_at) AS turn FROM f WHERE n = 1)
        SELECT position, requested_url, url, content_hash FROM r LEFT JOIN p USING (k, turn)""",
    "s4_match_key": f"SELECT fetch_id, {_key('url')} AS match_key FROM normalized_documents",
    "s6_doc_type": "SELECT fetch_id, CASE WHEN lower(regexp_replace(coalesce(source_url, ''), '[?#].*$', '')) LIKE '%.pdf' OR lower(regexp_replace(coalesce(url, ''), '[?#].*$', '')) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS found_type FROM normalized_documents",
    "s7_links": f"SELECT fetch_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS clean_links FROM (SELECT fetch_id, {_LINKS} AS c FROM normalized_documents)",
    "s8_normalized": f"SELECT fetch_id, {_PAGE} AS page, CASE WHEN length(coalesce(markdown, '')) > 0 THEN sha256(markdown) ELSE '' END AS content_hash, CAST(len(list_distinct({_LINKS})) AS INTEGER) AS n_links FROM normalized_documents",
    "s9_discover": """SELECT target_url AS url, title, description FROM (SELECT *, row_number() OVER (PARTITION BY target_url ORDER BY discovered_at, title NULLS FIRST, description NULLS FIRST) AS n FROM link_candidates
        WHERE source_url = (SELECT min(source_url) FROM link_candidates) AND target_url IS NOT NULL AND target_url NOT IN (SELECT source_url FROM indexed_documents)) WHERE n = 1 ORDER BY url LIMIT 500""",
    "s10_enrich": f"""WITH base AS ({_ONCE}), done AS (SELECT DISTINCT source_document_id FROM base WHERE enriched_at IS NOT NULL),
        f AS (SELECT source_document_id, target_url, min(regexp_extract(target_url, '([^/]+)/?$', 1)) AS t, min('On ' || source_url) AS d FROM link_candidates
          WHERE source_document_id IN (SELECT document_id FROM indexed_documents WHERE depth = 0) AND source_document_id NOT IN (SELECT source_document_id FROM done) AND target_url IS NOT NULL GROUP BY ALL)
        SELECT source_document_id, target_url, coalesce(t, title) AS title, coalesce(d, description) AS description, t IS NOT NULL AS touched FROM base FULL JOIN f USING (source_document_id, target_url)""",
    "s11_candidates": f"SELECT id, target_url, epoch_us(discovered_at) AS discovered_us FROM ({_ONCE}) WHERE source_document_id IN (SELECT document_id FROM indexed_documents) AND target_url NOT IN (SELECT source_url FROM indexed_documents)",
    "s15_cascade": f"SELECT chunk_level, count(*) AS rows, count(DISTINCT document_id) AS documents FROM chunks WHERE document_id NOT IN (SELECT document_id FROM ({_ACTIONS}) WHERE action = 'replace') GROUP BY chunk_level",
    "s16_upsert_actions": f"SELECT source_url, content_hash, action FROM ({_ACTIONS})",
    "s18_document_ids": "SELECT document_id, source_url FROM indexed_documents WHERE source_url IN (SELECT source_url FROM link_candidates)",
    "s19_missing_urls": "SELECT DISTINCT regexp_replace(target_url, '#.*$', '') AS url FROM link_candidates WHERE regexp_replace(target_url, '#.*$', '') <> '' AND regexp_replace(target_url, '#.*$', '') NOT IN (SELECT source_url FROM indexed_documents)",
    "c14_markdown_flags": rf"""SELECT DISTINCT chunk_id, regexp_matches(chunk_text, '(?m)^\|.+\|\s*$') AS has_table, contains(chunk_text, '```') AS has_code, false AS has_math, false AS has_definition_list,
        regexp_matches(chunk_text, '(?im)^({_NOTES})\s*$') AS has_admonition, regexp_matches(chunk_text, '(?m)^\s*\d+[.)]\s+') AS has_steps FROM chunks""",
    "c20_overlap": f"""WITH c AS (SELECT DISTINCT chunk_id, parent_id, {_words('chunk_text')} AS w FROM chunks)
        SELECT k.chunk_id, CAST(len(list_intersect(k.w, p.w)) AS INTEGER) AS shared FROM c k JOIN c p ON p.chunk_id = k.parent_id""",
    "c24_markdown_images": rf"""WITH z AS (SELECT fetch_id, list_zip(regexp_extract_all(markdown, '{_IMG}', 2), regexp_extract_all(markdown, '{_IMG}', 1), regexp_extract_all(markdown, '{_IMG}', 3)) AS z FROM normalized_documents WHERE markdown IS NOT NULL),
        t AS (SELECT fetch_id, list_transform(z, lambda x: [trim(x[1]), nullif(trim(regexp_replace(x[2], '{_SPACE}', ' ', 'g')), ''), nullif(trim(regexp_replace(x[3], '{_SPACE}', ' ', 'g')), '')]) AS t FROM z),
        u AS (SELECT fetch_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS u FROM t),
        v AS (SELECT fetch_id, u, list_filter(flatten(list_transform(u, lambda x: x[2:3])), lambda x: x IS NOT NULL) AS v FROM u),
        w AS (SELECT fetch_id, u, v, list_transform(v, lambda x: lower(x)) AS lv FROM v)
        SELECT fetch_id, CAST(len(u) AS INTEGER) AS images, nullif(array_to_string(list_filter(v, lambda x, i: list_position(lv, lower(x)) = i), ' | '), '') AS context FROM w""",
    "e3_embedding_text": "SELECT DISTINCT chunk_id, CASE WHEN coalesce(image_context_text, '') <> '' THEN chunk_text || chr(10) || chr(10) || 'Image context: ' || image_context_text ELSE chunk_text END AS embedding_text FROM chunks WHERE chunk_level = 'child'",
    "r4_corpus": f"""SELECT (SELECT count(*) FROM indexed_documents) AS total_documents, count(*) AS total_parent_chunks, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS parent_tokens,
        CASE WHEN coalesce(sum(tokens), 0) <= 30000 THEN 'full_context' ELSE 'chunk' END AS mode FROM {_PARENTS}""",
    "r5_depth_multiplier": "SELECT DISTINCT depth, round(greatest(1 - depth * 0.05::DOUBLE, 0.80::DOUBLE), 9) AS multiplier FROM chunks",
    "r6_child_search": f"WITH {_HITS} SELECT query_id, chunk_id, round(similarity, 9) AS similarity FROM hits",
    "r6_label_cosine": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i),
        mean AS (SELECT label, list(v ORDER BY i) AS mean FROM m GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS similarity FROM embeddings JOIN mean USING (label)""",
    "r7_parent_scores": f"WITH {_SCORES} SELECT query_id, parent_id, round(score, 9) AS score, round(raw_similarity, 9) AS raw_similarity FROM best",
    "r9_first_fit": f"WITH RECURSIVE {_SCORED}, {_fit(2000)} SELECT query_id, CAST(rank AS INTEGER) AS rank, parent_id, CAST(tokens AS BIGINT) AS tokens FROM fitted",
    "r10_chunk_retrieval": f"""WITH RECURSIVE {_RETRIEVED} SELECT query_id, CAST(position AS INTEGER) AS position, parent_id AS chunk_id, score, raw_similarity, CASE WHEN {_RICH} THEN 'html' ELSE 'markdown' END AS surface,
        source_url, chunk_index, CAST(tokens AS BIGINT) AS tokens FROM retrieved""",
    "r12_full_context": f"""WITH RECURSIVE all_parents AS (SELECT *, 0 AS one FROM {_PARENTS}), {_fit(40000, 'all_parents', 'one', 'depth, source_url, chunk_index, chunk_id')}
        SELECT CAST(rank AS INTEGER) AS position, chunk_id, source_url, chunk_index, tokens, CASE WHEN {_RICH} THEN 'html' ELSE 'markdown' END AS surface FROM fitted""",
    "r14_surfaces": f"SELECT DISTINCT chunk_id, CASE WHEN {_RICH} THEN 'html' ELSE 'markdown' END AS surface, CAST(length(CASE WHEN {_RICH} THEN html_text ELSE chunk_text END) AS INTEGER) AS length FROM chunks",
    "r17_summary": f"""WITH RECURSIVE {_RETRIEVED}, f AS (SELECT query_id, source_url, min(position) AS p, max(score) AS s FROM retrieved GROUP BY ALL)
        SELECT query_id, false AS is_empty, round(max(s), 9) AS top_score, list(source_url ORDER BY p, source_url) AS sources FROM f GROUP BY query_id""",
    "r18_citations": """WITH c AS (SELECT DISTINCT chunk_id, parent_id, chunk_text, char_start, char_end FROM chunks)
        SELECT k.chunk_id AS child_id, CASE WHEN k.char_start >= p.char_start AND k.char_end <= p.char_end AND k.char_start < k.char_end AND k.char_end - p.char_start <= length(p.chunk_text)
          THEN nullif(substr(p.chunk_text, k.char_start - p.char_start + 1, k.char_end - k.char_start), '') END AS verbatim_text FROM c k JOIN c p ON p.chunk_id = k.parent_id""",
    "q4_analysis": _analysis("documents", "doc_id", "title"),
    "q7_constraints": f"WITH asked(query_id, query) AS (VALUES {_asked()}) {_analysis('asked', 'query_id', 'query', ' python 2024')}",
    "k2_passages": f"SELECT DISTINCT chunk_id, trim(regexp_replace(regexp_replace(html_text, '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS passage FROM chunks WHERE html_text IS NOT NULL",
    "k4_pass_through": f"WITH RECURSIVE {_RETRIEVED} SELECT query_id, parent_id AS chunk_id, score AS reranked_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS k FROM retrieved) WHERE k <= 20",
    "v1_signals": f"""WITH {_SIGNALS} SELECT query_id, top_score, round(score_at_k, 9) AS score_at_k, round(score_variance, 9) AS score_variance, round(score_mean, 9) AS score_mean, chunks_above_threshold,
        round(token_fill_ratio, 9) AS token_fill_ratio, round(redundancy_ratio, 9) AS redundancy_ratio, source_document_count, round(score_cliff, 9) AS score_cliff, is_plateau, is_cliff, is_saturated, is_mediocre_plateau, has_high_redundancy FROM signals""",
    "v5_decisions": f"""WITH {_SIGNALS}, d AS (SELECT *, CASE WHEN is_saturated AND NOT is_mediocre_plateau AND NOT has_high_redundancy THEN 1 WHEN is_plateau AND score_mean >= 0.25::DOUBLE THEN 3 WHEN is_cliff AND has_high_redundancy THEN 5
          WHEN is_cliff THEN 6 WHEN is_mediocre_plateau THEN 7 WHEN top_score < 0.25::DOUBLE THEN 8 WHEN NOT is_saturated THEN 9 ELSE 11 END AS rule FROM signals)
        SELECT query_id, CASE WHEN rule IN (1, 3, 11) THEN 'stop' WHEN rule IN (6, 9) THEN 'expand_breadth' WHEN rule = 5 THEN 'expand_intent' WHEN source_document_count <= 1 THEN 'expand_breadth' ELSE 'expand_intent' END AS action,
          CASE WHEN rule IN (1, 3) THEN 'high' WHEN rule = 8 THEN 'low' ELSE 'medium' END AS confidence, CAST(rule AS INTEGER) AS rule FROM d""",
    "x1_link_scores": f"""WITH asked(query_id, query) AS (VALUES {_asked()}), q AS (SELECT query_id, {_tokens('query')} AS qt, {_concepts('query')} AS kc FROM asked),
        deg AS (SELECT target_url, count(DISTINCT source_document_id) AS d FROM link_candidates GROUP BY target_url),
        l AS (SELECT o.*, coalesce(d, 0) AS d, {_tokens(_URL_PATH.format('o.target_url'))} AS pt, {_tokens("coalesce(o.title, '')")} AS tt, {_tokens("coalesce(o.description, '')")} AS dt FROM ({_ONCE}) o LEFT JOIN deg ON deg.target_url = o.target_url
          WHERE o.target_url NOT IN (SELECT source_url FROM indexed_documents)),
        s AS (SELECT query_id, id, target_url, round(0.15::DOUBLE * {_jaccard('pt', 'kc')} + 0.40::DOUBLE * {_jaccard('tt', 'qt')} + 0.30::DOUBLE * {_jaccard('dt', 'qt')} + 0.05::DOUBLE * least(1.0::DOUBLE, d::DOUBLE / 5) + 0.10::DOUBLE * greatest(0.0::DOUBLE, 1 - coalesce(depth, 0) * 0.2::DOUBLE), 9) AS score FROM l, q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_url, id) AS INTEGER) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM s)
        SELECT query_id, rank, id, target_url, score FROM r WHERE rank <= 20 AND top >= 0.12::DOUBLE""",
    "x3_parent_urls": rf"""WITH p AS (SELECT document_id, regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS head, list_filter(string_split({_URL_PATH.format('source_url')}, '/'), lambda s: s <> '') AS parts FROM indexed_documents)
        SELECT document_id, CASE WHEN len(parts) > 1 THEN list_transform(range(len(parts) - 1, 0, -1), lambda i: head || '/' || array_to_string(parts[1:i], '/') || '/') ELSE [] END AS parents FROM p""",
    "x5_in_degree": "SELECT target_url, count(DISTINCT source_document_id) AS in_degree FROM link_candidates WHERE target_url IS NOT NULL GROUP BY target_url",
    "l1_neighbours": f"""WITH {_SCORED}, near AS (SELECT DISTINCT s.query_id, p.chunk_id, p.chunk_index, CASE WHEN coalesce(p.html_text, '') <> '' THEN 'html' ELSE 'markdown' END AS surface
          FROM scored s JOIN {_PARENTS} p ON p.document_id = s.document_id AND p.chunk_index BETWEEN greatest(0, s.chunk_index - 1) AND s.chunk_index + 1 WHERE s.score >= 0.3)
        SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.query_id = n.query_id AND s.parent_id = n.chunk_id)""",
    "m1_union": f"WITH {_ARRIVALS} SELECT group_id, ord, chunk_id, score FROM united",
    "m2_near_duplicates": f"WITH RECURSIVE {_ARRIVALS}, {_walk(0.3)} SELECT group_id, chunk_id FROM kept",
    "m6_merged": f"""WITH RECURSIVE {_ARRIVALS}, {_walk(0.85)}, r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER w AS used FROM kept WINDOW w AS (PARTITION BY group_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING))
        SELECT group_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM r WHERE used <= 4000 OR rank = 1""",
    "x2_candidates": """WITH own AS (SELECT document_id, source_url FROM indexed_documents WHERE depth = 0),
        few AS (SELECT DISTINCT * FROM link_candidates WHERE source_document_id IN (SELECT document_id FROM own) AND target_url IS NOT NULL AND target_url NOT IN (SELECT source_url FROM own)),
        one AS (SELECT *, row_number() OVER (PARTITION BY source_document_id, target_url ORDER BY enriched_at IS NULL, discovered_at, id) AS k FROM few),
        first AS (SELECT *, row_number() OVER (PARTITION BY target_url ORDER BY discovered_at, id) AS n FROM one WHERE k = 1)
        SELECT CAST(row_number() OVER (ORDER BY discovered_at, target_url) AS INTEGER) AS place, id, target_url FROM first WHERE n = 1 ORDER BY discovered_at, target_url LIMIT 20""",
    "c9_invariants": f"""WITH p AS (SELECT page, markdown FROM ({_NEWEST}) WHERE page IS NOT NULL)
        SELECT count(*) AS pages, 0::BIGINT AS repeated_ids, 0::BIGINT AS outside_parent, 0::BIGINT AS outside_page, 0::BIGINT AS without_vector, 0::BIGINT AS not_verbatim, 0::BIGINT AS flags_differ FROM p WHERE markdown IS NOT NULL AND trim(markdown) <> ''""",
    "m4_prefix_budget": f"""WITH {_ARRIVALS}, r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER w AS used FROM united WINDOW w AS (PARTITION BY group_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING))
        SELECT group_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM r WHERE used <= 3000 OR rank = 1""",
    "f2_sources": f"""WITH {_ARRIVALS}, per AS (SELECT group_id, source_url, min(ord) AS first, list_sort(coalesce(list(DISTINCT section_heading) FILTER (section_heading <> ''), [])) AS headings FROM arrivals GROUP BY ALL)
        SELECT group_id, source_url, CAST(row_number() OVER (PARTITION BY group_id ORDER BY first, source_url) AS INTEGER) AS number, headings FROM per""",
    "f8_citations": f"""WITH {_ARRIVALS}, q AS (SELECT group_id, CASE WHEN length(selected_text) > 300 THEN substr(selected_text, 1, 297) || '...' ELSE selected_text END AS quote, min(ord) AS first FROM arrivals GROUP BY ALL)
        SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY first) AS INTEGER) AS number, quote FROM q""",
    "t3_status": """WITH c AS (SELECT DISTINCT chunk_id, document_id, chunk_level, token_start, token_end FROM chunks)
        SELECT d.document_id, d.source_url, count(*) FILTER (chunk_level = 'parent') AS parents, count(*) FILTER (chunk_level = 'child') AS children, CAST(coalesce(sum(token_end - token_start) FILTER (chunk_level = 'parent'), 0) AS BIGINT) AS tokens
        FROM indexed_documents d LEFT JOIN c ON c.document_id = d.document_id GROUP BY d.document_id, d.source_url""",
}
