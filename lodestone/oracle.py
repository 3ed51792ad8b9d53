"""The registered queries in SQL, for checking results on another engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

_TOKENS = r"""list_filter(string_split_regex(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'),
    lambda t: t <> '')"""
_WORDS = r"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"

_DOC_TOKENS = f"docs AS (SELECT doc_id, {_TOKENS.format(text='text')} AS tokens FROM documents)"


def _bm25(query: str, k: int = 5, docs: str = _DOC_TOKENS, result: str | None = None) -> str:
    return f"""
    WITH {docs},
    words AS (SELECT item_id AS qid,
        unnest({_WORDS.format(text=f"regexp_replace({query}, '[\"*()\\-+^:]', ' ', 'g')")}) AS w FROM benchmark),
    phrases AS (SELECT qid, tokens, array_to_string(tokens, ' ') AS phrase, count(*) AS weight
        FROM (SELECT qid, {_TOKENS.format(text='w')} AS tokens FROM words) WHERE len(tokens) > 0 GROUP BY ALL),
    terms AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs),
    single AS (SELECT doc_id, dl, term AS phrase, count(*) AS tf FROM terms
        WHERE term IN (SELECT phrase FROM phrases WHERE len(tokens) = 1) GROUP BY ALL),
    multi AS (SELECT d.doc_id, len(d.tokens) AS dl, p.phrase,
            len(list_filter(range(1, len(d.tokens) - len(p.tokens) + 2),
                lambda i: d.tokens[i:i + len(p.tokens) - 1] = p.tokens)) AS tf
        FROM (SELECT doc_id, tokens, ' ' || array_to_string(tokens, ' ') || ' ' AS joined FROM docs) d,
             (SELECT DISTINCT phrase, tokens FROM phrases WHERE len(tokens) > 1) p
        WHERE contains(d.joined, ' ' || p.phrase || ' ')),
    freq AS (SELECT * FROM single UNION ALL SELECT * FROM multi),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM docs),
    df AS (SELECT phrase, count(*)::DOUBLE AS df FROM freq GROUP BY phrase),
    gain AS (SELECT phrase, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6
        ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) AS idf FROM df, stats),
    scores AS (SELECT qid, doc_id,
            sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM freq JOIN gain USING (phrase) JOIN phrases USING (phrase), stats GROUP BY qid, doc_id),
    ranked AS (SELECT qid, doc_id, score,
        row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, doc_id) AS rank FROM scores)
    {result or f"SELECT qid, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {k}"}
    """


SQL["bm25_topk"] = _bm25("text")
SQL["bm25_index_topk"] = _bm25("text")
SQL["bm25_phrases"] = _bm25("replace(text, ' ', '/')")

SQL["term_statistics"] = f"""
    WITH {_DOC_TOKENS}, terms AS (SELECT doc_id, unnest(tokens) AS term FROM docs)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY term
"""
SQL["corpus_statistics"] = f"""
    WITH {_DOC_TOKENS} SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl FROM docs
"""
SQL["query_phrases"] = f"""
    WITH words AS (SELECT conv_id * 1000 + turn AS qid,
        unnest({_WORDS.format(text="regexp_replace(text, '[\"*()\\-+^:]', ' ', 'g')")}) AS w FROM conversations)
    SELECT qid, array_to_string(tokens, ' ') AS phrase, count(*) AS weight
    FROM (SELECT qid, {_TOKENS.format(text='w')} AS tokens FROM words) WHERE len(tokens) > 0 GROUP BY qid, tokens
"""

_OVERLAP = f"""
    q AS (SELECT qid, token, count(*) AS weight FROM (SELECT item_id AS qid,
        unnest({_WORDS.format(text='lower(text)')}) AS token FROM benchmark) GROUP BY ALL),
    scores AS (SELECT qid, doc_id, sum(weight)::BIGINT AS score
        FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN q ON contains(low, token) GROUP BY qid, doc_id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores
        QUALIFY rank <= 5)
"""
SQL["overlap_topk"] = f"WITH {_OVERLAP} SELECT qid, rank, doc_id, score FROM hits"
SQL["context_assembly"] = f"""
    WITH {_OVERLAP},
    ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS c, count(*) AS n
        FROM hits JOIN documents USING (doc_id) GROUP BY qid)
    SELECT item_id AS qid, coalesce(n, 0) AS passages,
        md5('Context:' || chr(10) || coalesce(c, 'No context available.') || chr(10) || chr(10)
            || 'Question: ' || b.text) AS prompt_md5
    FROM benchmark b LEFT JOIN ctx ON qid = item_id
"""

_CHUNKS = f"""
    w AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    n AS (SELECT doc_id, w, unnest(range(0,
        CASE WHEN len(w) <= 300 THEN 1 ELSE ceil((len(w) - 300) / 250.0)::BIGINT + 1 END)) AS chunk_no FROM w
        WHERE len(w) > 0),
    chunks AS (SELECT doc_id, chunk_no,
        array_to_string(w[chunk_no * 250 + 1 : chunk_no * 250 + 300], ' ') AS chunk FROM n)
"""
SQL["chunk_words"] = f"WITH {_CHUNKS} SELECT doc_id, chunk_no, chunk FROM chunks"
SQL["chunk_md5"] = f"""
    WITH {_CHUNKS} SELECT md5(chunk) AS source_hash, count(*) AS copies, min(doc_id) AS first_doc
    FROM chunks GROUP BY md5(chunk)
"""
SQL["clean_documents"] = r"""
    SELECT count(*) AS store_size, sum(length(t))::BIGINT AS chars
    FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''
"""
SQL["doc_dedup_first"] = "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text"
SQL["extract_paragraphs"] = """
    SELECT min(doc_id) AS doc_id, p AS text
    FROM (SELECT doc_id, source || ': ' || replace(text, chr(10), ' ') AS p FROM documents) GROUP BY p
"""
SQL["extract_questions"] = """
    SELECT conv_id * 1000 + turn AS idx, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS type,
        'unknown' AS level, text AS question, CASE WHEN role = 'assistant' THEN text ELSE '' END AS expected
    FROM conversations
"""


def _sample(keys: str, n: int) -> str:
    return f"""
    WITH base AS (SELECT doc_id, {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) AS nth,
            count(*) OVER (PARTITION BY {keys}) AS size, min(doc_id) OVER (PARTITION BY {keys}) AS first_seen,
            count(*) OVER () AS total FROM documents),
    flagged AS (SELECT *, nth <= greatest(1, round_even({n} * size / total::DOUBLE, 0)) AS taken FROM base),
    ordered AS (SELECT *, row_number() OVER (ORDER BY NOT taken,
        CASE WHEN taken THEN first_seen ELSE 0 END, CASE WHEN taken THEN nth ELSE doc_id END) AS position FROM flagged)
    SELECT position, doc_id, {keys} FROM ordered WHERE position <= {n}
    """


SQL["stratified_sample"] = _sample("lang, source", 100)
SQL["stratified_sample_padded"] = _sample("lang", 7)
SQL["strata_counts"] = "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source"
SQL["counts_per_key"] = """
    SELECT 'quality' AS key, quality::VARCHAR AS value, count(*) AS n FROM labels GROUP BY quality
    UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY toxic
"""

_VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_MEANS = """
    parts AS (SELECT label, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x FROM v),
    means AS (SELECT label::BIGINT AS qid, list(x ORDER BY d) AS m
        FROM (SELECT label, d, avg(x) AS x FROM parts GROUP BY label, d) GROUP BY label)
"""


def _label_hits(k: int, name: str = "hits", vec: str = "e") -> str:
    return f"""{name} AS (SELECT qid, id, cos, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 12) DESC, id)
        AS rank FROM (SELECT qid, id, list_cosine_similarity(m, {vec}) AS cos FROM means, v) QUALIFY rank <= {k})"""


SQL["vector_topk_cutoff"] = f"""
    WITH {_VEC}, {_MEANS}, {_label_hits(20)}
    SELECT qid, rank, id, round(1 - (1 - cos) / 2, 6) AS sim FROM hits WHERE 1 - (1 - cos) / 2 >= 0.68
"""
SQL["vector_knn_join"] = f"""
    WITH {_VEC}, pairs AS (SELECT a.id AS qid, b.id, list_cosine_similarity(a.e, b.e) AS cos FROM v a, v b)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 12) DESC, id) AS rank, id,
        round(cos, 6) AS cos FROM pairs QUALIFY rank <= 5
"""
SQL["label_cohesion"] = f"""
    WITH {_VEC}, {_MEANS}
    SELECT id AS vec_id, round(1 - (1 - list_cosine_similarity(e, m)) / 2, 6) AS sim FROM v JOIN means ON label = qid
"""

_SIMS = "s AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b WHERE a.id < b.id)"


def _greedy(compare: str) -> str:
    return f"""
    {_VEC}, {_SIMS},
    nb AS (SELECT v.id, row_number() OVER (ORDER BY v.id) AS rn, coalesce(l, []) AS nb FROM v
        LEFT JOIN (SELECT j, list(i) AS l FROM s WHERE sim {compare} 0.35 GROUP BY j) ON j = v.id),
    fold(rn, kept) AS (SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL SELECT nb.rn, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, id) END
        FROM fold JOIN nb ON nb.rn = fold.rn + 1),
    kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM fold ORDER BY rn DESC LIMIT 1))
    """


SQL["semantic_dedup_kept"] = f"WITH RECURSIVE {_greedy('>')} SELECT id FROM kept"
SQL["entity_resolution"] = f"""
    WITH RECURSIVE {_greedy('>=')}
    SELECT v.id, CASE WHEN v.id IN (SELECT id FROM kept) THEN v.id ELSE best END AS owner FROM v
    LEFT JOIN (SELECT j, arg_max(i, sim) AS best FROM s WHERE sim >= 0.35 AND i IN (SELECT id FROM kept) GROUP BY j)
        ON j = v.id
"""
SQL["entity_candidates"] = f"""
    WITH {_VEC}, p AS (SELECT a.id, b.id AS cand, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b
        WHERE a.id <> b.id)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, cand) AS rank, cand,
        round(sim, 6) AS sim FROM p WHERE sim >= 0.35 QUALIFY rank <= 5
"""
SQL["alias_resolve"] = """
    WITH known AS (SELECT DISTINCT lower(trim(p_name)) AS k FROM part),
    alias AS (SELECT lower(trim(p_brand)) AS a, lower(trim(min(p_name))) AS k FROM part GROUP BY p_brand),
    names AS (SELECT p_partkey, unnest(['  ' || upper(p_name), p_brand, p_type]) AS name FROM part)
    SELECT p_partkey, name, coalesce(known.k, alias.k, lower(trim(name))) AS entity_key FROM names
    LEFT JOIN known ON known.k = lower(trim(name)) LEFT JOIN alias ON a = lower(trim(name))
"""
_TRIPS = """
    t AS (SELECT vec_id AS id, '[Topic ' || label || '] covers item of topic ' || label || ' [Item ' || vec_id || ']'
        AS text, 'topic ' || label AS sk, 'item ' || vec_id AS ok FROM embeddings)
"""
SQL["knn_1hop"] = f"""
    WITH {_VEC}, {_MEANS}, {_label_hits(5)}, {_TRIPS},
    matched AS (SELECT DISTINCT qid, unnest([sk, ok]) AS k FROM hits JOIN t USING (id)),
    entries AS (SELECT qid, text, 0 AS src, rank AS place FROM hits JOIN t USING (id)
        UNION ALL SELECT qid, text, 1, id FROM matched JOIN t ON k = sk OR k = ok),
    once AS (SELECT qid, text, min((src, place)) AS spot FROM entries GROUP BY qid, text)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY spot) AS rank, text FROM once QUALIFY rank <= 20
"""
SQL["hybrid_context"] = f"""
    WITH {_VEC}, {_MEANS}, {_label_hits(5, 'local')}, {_label_hits(5, 'overall', 'list_reverse(e)')},
    names AS (SELECT qid, min((src, place)) AS spot, name FROM (
            SELECT qid, 0 AS src, rank AS place, 'Item ' || id AS name FROM local
            UNION ALL SELECT qid, 1, rank * 2, 'Topic ' || label FROM overall JOIN v USING (id)
            UNION ALL SELECT qid, 1, rank * 2 + 1, 'Item ' || id FROM overall) GROUP BY qid, name),
    rels AS (SELECT qid, min((src, place)) AS spot, id FROM (
            SELECT qid, 0 AS src, rank AS place, id FROM overall
            UNION ALL SELECT qid, 1, id, id FROM local) GROUP BY qid, id)
    SELECT qid, 'Entities:' || chr(10) || n || chr(10) || chr(10) || 'Relations:' || chr(10) || r AS context
    FROM (SELECT qid, string_agg(name, chr(10) ORDER BY spot) AS n FROM names GROUP BY qid)
    JOIN (SELECT qid, string_agg('Topic ' || label || ' covers item Item ' || id, chr(10) ORDER BY spot) AS r
        FROM rels JOIN v USING (id) GROUP BY qid) USING (qid)
"""

_EDGES = """
    edges AS (SELECT n_nationkey::BIGINT * 4 AS eid, n_name AS s, 'part_of' AS p, r_name AS o
            FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT s_suppkey * 4 + 1, s_name, 'located_in', n_name FROM supplier
            JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT c_custkey * 4 + 2, c_name, 'located_in', n_name FROM customer
            JOIN nation ON c_nationkey = n_nationkey)
"""
SQL["graph_bfs_2hop"] = f"""
    WITH {_EDGES},
    ends AS (SELECT DISTINCT eid, node FROM (SELECT eid, s AS node FROM edges UNION ALL SELECT eid, o FROM edges)),
    nodes AS (SELECT DISTINCT node FROM ends),
    tokens AS (SELECT s_suppkey AS qid, unnest(string_split(lower('where is ' || s_name || ' at'), ' ')) AS token
        FROM supplier),
    hit AS (SELECT token, node FROM (SELECT DISTINCT token FROM tokens WHERE length(token) > 2), nodes
        WHERE contains(lower(node), token)),
    seeds AS (SELECT DISTINCT qid, node FROM tokens JOIN hit USING (token)),
    h1 AS (SELECT DISTINCT qid, eid FROM seeds JOIN ends USING (node)),
    f2 AS (SELECT DISTINCT qid, node FROM h1 JOIN ends USING (eid) EXCEPT SELECT qid, node FROM seeds),
    h2 AS (SELECT DISTINCT qid, eid FROM f2 JOIN ends USING (node) EXCEPT SELECT qid, eid FROM h1),
    found AS (SELECT qid, 1 AS hop, eid FROM h1 UNION ALL SELECT qid, 2, eid FROM h2)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY hop, eid) AS rank, hop, eid,
        s || ' ' || replace(p, '_', ' ') || ' ' || o AS text FROM found JOIN edges USING (eid) QUALIFY rank <= 5
"""
SQL["graph_size"] = f"""
    WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT s FROM edges UNION SELECT o FROM edges)) AS nodes,
        (SELECT count(*) FROM edges) AS edges
"""
SQL["triple_exact_dedup"] = """
    SELECT min(l_orderkey * 16 + l_linenumber) AS eid, 'Supplier ' || l_suppkey AS subject,
        'ships_' || l_returnflag AS predicate, 'Part ' || l_partkey AS object
    FROM lineitem GROUP BY l_suppkey, l_returnflag, l_partkey
"""
SQL["edge_replies"] = """
    SELECT event_id AS doc_id, 1 AS item_no, 'User ' || user_id AS subject, event_type AS predicate,
        event_type AS object FROM events WHERE event_type NOT IN ('error', 'view')
"""
_TRIPLET_REPLIES = """
    items AS (SELECT event_id AS doc_id, unnest([1, 2]) AS item_no, 'User ' || user_id AS subject,
            event_type AS predicate, 'Did ' || event_type AS description,
            unnest([event_type, user_id::VARCHAR]) AS object
        FROM events WHERE event_type NOT IN ('error', 'view')),
    valid AS (SELECT * FROM items WHERE object <> '0')
"""
SQL["triplet_replies"] = f"WITH {_TRIPLET_REPLIES} SELECT * FROM valid"
SQL["triplet_dedup"] = f"""
    WITH {_TRIPLET_REPLIES}
    SELECT min(doc_id * 8 + item_no) AS ord, '[' || subject || '] ' || description || ' [' || object || ']' AS text
    FROM valid GROUP BY subject, description, object
"""

_CALLS = """
    calls AS (SELECT *, event_type <> 'error' AS ok, 'run-' || user_id AS run_id,
        CASE event_type WHEN 'view' THEN 'retrieval_overhead' WHEN 'click' THEN 'agent_reasoning'
            WHEN 'error' THEN 'ingest' ELSE 'UNTAGGED' END AS phase,
        CASE event_type WHEN 'view' THEN 'vector_embed' ELSE 'langgraph_node' END AS actor,
        CASE WHEN event_type <> 'error' THEN event_type END AS variant_name,
        json_extract(props, '$.k')::BIGINT AS prompt, floor(value)::BIGINT AS completion,
        round_even(value / 16 * 1000, 2) AS ms FROM events),
    log AS (SELECT *, CASE WHEN value > 10 AND prompt + 1 <> 0 THEN prompt + 1 ELSE prompt + completion END AS total
        FROM calls)
"""
_COST = """count(*) FILTER (ok) AS calls, count(*) FILTER (NOT ok) AS failures,
    coalesce(sum(prompt) FILTER (ok), 0)::BIGINT AS prompt_tokens,
    coalesce(sum(completion) FILTER (ok), 0)::BIGINT AS completion_tokens, 0::BIGINT AS reasoning_tokens,
    coalesce(sum(total) FILTER (ok), 0)::BIGINT AS total_tokens, round(sum(ms) FILTER (ok), 2) AS latency_ms"""
SQL["telemetry_cost"] = f"WITH {_CALLS} SELECT variant_name, phase, actor, {_COST} FROM log GROUP BY ALL"
SQL["untagged_calls"] = f"""
    WITH {_CALLS} SELECT 'provider/model' AS model, variant_name, count(*) AS n FROM log
    WHERE ok AND phase = 'UNTAGGED' GROUP BY ALL
"""
SQL["call_index"] = """
    SELECT 'run-' || user_id AS run_id, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_index
    FROM events WHERE event_type <> 'error'
"""
SQL["results_join_cost"] = f"""
    WITH {_CALLS}, runs AS (SELECT run_id, {_COST} FROM log GROUP BY run_id)
    SELECT 'run-' || conv_id AS run_id, turn, coalesce(calls, 0) AS calls, coalesce(total_tokens, 0) AS total_tokens,
        coalesce(latency_ms, 0) AS latency_ms
    FROM conversations c LEFT JOIN runs ON runs.run_id = 'run-' || conv_id WHERE role = 'user'
"""

_NORMAL = r"""list_filter(string_split_regex(regexp_replace(translate(lower({text}),
    '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', ' ', 'g'),
    '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"""
_SCORES = f"""
    pairs AS (SELECT a.conv_id * 1000 + a.turn AS id, b.text AS answer, a.text AS expected
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'),
    tok AS (SELECT id, {_NORMAL.format(text='answer')} AS g, {_NORMAL.format(text='expected')} AS e FROM pairs),
    common AS (SELECT id, g, e, coalesce(list_sum(list_transform(list_distinct(g), lambda t: least(
        len(list_filter(g, lambda x: x = t)), len(list_filter(e, lambda y: y = t))))), 0)::DOUBLE AS c FROM tok),
    scores AS (SELECT id, (g = e)::INTEGER AS exact_match, CASE WHEN c = 0 OR (g <> e AND
        (array_to_string(g, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(e, ' ') IN ('yes', 'no', 'noanswer')))
        THEN 0.0 ELSE 2 * (c / len(g)) * (c / len(e)) / (c / len(g) + c / len(e)) END AS f1 FROM common)
"""
SQL["qa_em_f1"] = f"WITH {_SCORES} SELECT id, exact_match, round(f1, 6) AS f1 FROM scores"
SQL["qa_summary"] = f"""
    WITH {_SCORES} SELECT count(*) AS questions, round(avg(exact_match), 6) AS em, round(avg(f1), 6) AS f1 FROM scores
"""

SQL["qa_answers"] = f"""
    WITH {_OVERLAP},
    ctx AS (SELECT qid, count(*) AS n, string_agg(text, chr(10) ORDER BY rank) AS c
        FROM hits JOIN (SELECT doc_id, text FROM documents) USING (doc_id) GROUP BY qid)
    SELECT item_id AS qid, 'registered' AS variant_name, 'dummy' AS agent_type, b.text AS question, '' AS expected,
        string_split(coalesce(c, 'No context available.'), chr(10))[1] AS answer, coalesce(n, 0) AS passages,
        'retrieve,reason' AS steps, 'dummy' AS backend_name
    FROM benchmark b LEFT JOIN ctx ON qid = item_id
"""

# The stripped, non-blank documents in order, and behind them the first benchmark text as a later fact.
_STORED = r"""
    told AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
    stored AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS doc_id, text FROM told WHERE text <> ''
        UNION ALL SELECT 1000000000000, regexp_replace(min_by(text, item_id), '^\s+|\s+$', '', 'g') FROM benchmark)
"""
SQL["bm25_store_search"] = _bm25(
    "text", 5, f"{_STORED}, docs AS (SELECT doc_id, {_TOKENS.format(text='text')} AS tokens FROM stored)",
    "SELECT qid, rank, md5(text) AS text_md5 FROM ranked JOIN stored USING (doc_id) WHERE rank <= 5",
)

_LETTERS = (
    "list_transform(range(97, 123), lambda c: (length(lower({text})) - length(replace(lower({text}), chr(c::INTEGER), '')))::DOUBLE)"
)
SQL["vector_store_search"] = f"""
    WITH {_CHUNKS},
    pieces AS (SELECT doc_id, chunk_no, chunk FROM chunks
        UNION ALL SELECT 1000000000000, 0, regexp_replace(min_by(text, item_id), '^\\s+|\\s+$', '', 'g') FROM benchmark),
    vectors AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS id, chunk, {_LETTERS.format(text='chunk')} AS v FROM pieces),
    asked AS (SELECT item_id AS qid, {_LETTERS.format(text='text')} AS q FROM benchmark),
    sims AS (SELECT qid, id, chunk, list_dot_product(q, v) / greatest(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)), 1e-300) AS cos
        FROM asked, vectors),
    hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 12) DESC, id) AS rank FROM sims QUALIFY rank <= 5)
    SELECT qid, rank, md5(chunk) AS text_md5 FROM hits WHERE 1 - (1 - cos) / 2 >= 0.97
"""

_COUNT = "(length({text}) - length(replace({text}, ' ', '')) + 1)"
SQL["pipeline_cost"] = f"""
    WITH f AS (SELECT s_suppkey AS doc, {_COUNT.format(text='n_name')} AS w, n_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    places AS (SELECT n_name, any_value(w) AS w, row_number() OVER (ORDER BY min(doc)) AS j FROM f GROUP BY n_name),
    -- A name is shown the first five of its kind before it, in a prompt of twenty words and two a line.
    shown AS (
        SELECT 20 + 1 + 2 * least(5, row_number() OVER (ORDER BY doc) - 1) AS p, row_number() OVER (ORDER BY doc) AS j FROM f
        UNION ALL
        SELECT 20 + w + (SELECT sum(1 + b.w) FROM places b WHERE b.j <= least(5, a.j - 1)), a.j FROM places a),
    calls AS (
        SELECT 'ingest' AS phase, 'graph_extract' AS actor, 'offline/reader' AS model, 4 + w AS p, 2 * w + 2 AS c FROM f
        UNION ALL SELECT 'ingest', 'graph_extract', 'offline/reader', p, 1 FROM shown WHERE j > 1
        UNION ALL SELECT 'ingest', 'vector_embed', 'offline/letters', 1, 0 FROM f
        UNION ALL SELECT 'ingest', 'vector_embed', 'offline/letters', w, 0 FROM places
        UNION ALL SELECT 'ingest', 'vector_embed', 'offline/letters', 4 + w, 0 FROM f
        UNION ALL SELECT 'retrieval_overhead', 'vector_embed', 'offline/letters', 4 + {_COUNT.format(text='n_name')}, 0 FROM nation)
    SELECT phase, actor, model, count(*)::BIGINT AS calls, 0::BIGINT AS failures, sum(p)::BIGINT AS prompt_tokens,
        sum(c)::BIGINT AS completion_tokens, 0::BIGINT AS reasoning_tokens, sum(p + c)::BIGINT AS total_tokens
    FROM calls GROUP BY ALL
"""

SQL["choice_replies"] = """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND user_id % 8 BETWEEN 1 AND 5 THEN user_id % 8 END::BIGINT AS choice
    FROM events
"""
