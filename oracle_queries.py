"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

PUNCT_SPACE = r"[!-/:-@\[-`{-~\s\x1c-\x1f\x85\p{Z}]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def clean_query(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '{PUNCT_SPACE}', ' ', 'g'))"


def clean_index(text: str) -> str:
    """The tables hold no Devanagari, so the romanised copy equals the text."""
    return f"trim(regexp_replace(lower(coalesce({text}, '')) || ' ' || lower(coalesce({text}, '')), '{SPACE}', ' ', 'g'))"


def squash(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}|{SPACE}$', '', 'g')"


def title(text: str) -> str:
    """Words of letters start with a capital, wherever they start."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({text}), '[a-z]+|[^a-z]+'), "
        "lambda r: upper(r[1]) || r[2:]), '')"
    )


def plain(markup: str) -> str:
    text = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for reference, character in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{reference}', '{character}')"
    return squash(text)


FIRST_LINE = "split_part(text, chr(10), 1)"

Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings)"
C = (
    "c AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v "
    "FROM embeddings)"
)
PAIRS = """
pairs AS (
  SELECT query_id, doc_id,
         round(power(list_distance(q.v, c.v), 2), 6) AS d2,
         round(list_inner_product(q.v, c.v)
               / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 6) AS cosine
  FROM q CROSS JOIN c)"""


def ranked(k: int) -> str:
    return f"""
ranked AS (
  SELECT query_id, 'l2' AS metric, doc_id, d2 AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY d2, doc_id)::INTEGER AS rank
  FROM pairs QUALIFY rank <= {k}
  UNION ALL
  SELECT query_id, 'cosine', doc_id, cosine,
         row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id)::INTEGER AS rank
  FROM pairs WHERE cosine IS NOT NULL QUALIFY rank <= {k})"""


HITS = f"WITH {Q}, {C}, {PAIRS}, {ranked(10)}"

FACET_QUERIES = """
fq AS (
  SELECT vec_id AS query_id,
         CASE WHEN vec_id % 4 = 0 THEN 'All States' WHEN vec_id % 4 = 1 THEN 'SRC' || (vec_id * 7 % 22) END AS explicit_facet,
         CASE WHEN vec_id % 3 <> 2 THEN 'loans from Src' || (vec_id * 3 % 25) || ' today' ELSE 'loans' END AS text
  FROM embeddings),
named AS (
  SELECT query_id, min(source) AS detected_facet
  FROM fq JOIN (SELECT DISTINCT source FROM documents) ON contains(lower(text), lower(source)) GROUP BY 1),
resolved AS (
  SELECT fq.query_id, explicit_facet, detected_facet,
         coalesce(nullif(explicit_facet, 'All States'), detected_facet) AS facet_used,
         CASE WHEN nullif(explicit_facet, 'All States') IS NOT NULL THEN 'explicit'
              WHEN detected_facet IS NOT NULL THEN 'detected' ELSE 'none' END AS facet_origin
  FROM fq LEFT JOIN named USING (query_id))"""


def compared(used: str, always: str, k: int, overfetch: int | None, base: str = f"{Q}, {C}, {PAIRS}") -> str:
    """Candidates, facet filter, fallback and cut; ``used`` gives ``(query_id, facet_used)``."""
    judged = f"""
used AS ({used}),
facets AS (SELECT doc_id, source AS facet FROM documents),
long AS (
  SELECT query_id, 'l2' AS metric, doc_id, d2 AS score, d2 AS cost FROM pairs
  UNION ALL SELECT query_id, 'cosine', doc_id, cosine, -cosine FROM pairs WHERE cosine IS NOT NULL),
cand AS (
  SELECT long.*, facet, facet_used,
         facet_used IS NULL OR coalesce(lower(facet) = lower(facet_used) OR {always}, false) AS matched
  FROM (SELECT * FROM long {f'QUALIFY row_number() OVER (PARTITION BY query_id, metric ORDER BY cost, doc_id) <= {k * overfetch}' if overfetch else ''}) long
  JOIN used USING (query_id) LEFT JOIN facets USING (doc_id)),
kept AS (
  SELECT *, bool_or(matched) OVER (PARTITION BY query_id, metric) AS any_match FROM cand QUALIFY matched OR NOT any_match),
found AS (
  SELECT query_id, metric, row_number() OVER (PARTITION BY query_id, metric ORDER BY cost, doc_id)::INTEGER AS rank,
         doc_id, score, cost, facet, facet_used,
         CASE WHEN facet_used IS NOT NULL THEN NOT any_match END AS fallback_used
  FROM kept QUALIFY rank <= {k})"""
    return f"WITH {base}, {judged}"


ALWAYS_SRC1 = "contains(lower(facet), 'src1')"
RESOLVED_USED = f"WITH {FACET_QUERIES} SELECT query_id, facet_used FROM resolved"
FILTERED = compared(RESOLVED_USED, ALWAYS_SRC1, 10, 10)
FOUND = "SELECT query_id, metric, rank, doc_id, score, facet, facet_used, fallback_used FROM found"
BUCKET = f"""CASE WHEN facet_used IS NULL OR lower(facet) = lower(facet_used) THEN 0
  WHEN {ALWAYS_SRC1} THEN 1 ELSE 2 END::INTEGER"""


def positioned(order: str) -> str:
    return f"""{FILTERED},
    b AS (SELECT *, {BUCKET} AS bucket FROM found)
    SELECT query_id, metric, bucket, doc_id, score,
           row_number() OVER (PARTITION BY query_id, metric ORDER BY bucket, {order}, doc_id)::INTEGER AS position FROM b"""


def tfidf(cleaner) -> str:
    """Sparse TF-IDF weights of all documents, and the terms behind them."""
    combined = f"{cleaner(FIRST_LINE)} || ' ' || {cleaner('text')} || ' ' || " + cleaner("(lang || ', ' || source)")
    return f"""
words AS (
  SELECT doc_id, unnest(list_filter(string_split({combined}, ' '), lambda w: w <> '')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY 1),
terms AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1.0 AS idf,
         ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket
  FROM words GROUP BY term),
cw AS (
  SELECT doc_id, bucket, (sum(idf) / any_value(n_words))::FLOAT::DOUBLE AS w
  FROM words JOIN terms USING (term) JOIN sizes USING (doc_id) GROUP BY 1, 2)"""


def text_pairs(cleaner) -> str:
    """Scores of all (text query, document) pairs from their sparse weights."""
    query_text = cleaner("(text || ' src' || (item_id % 23))")
    return f"""{tfidf(cleaner)},
qwords AS (
  SELECT item_id AS query_id, unnest(list_filter(string_split({query_text}, ' '), lambda w: w <> '')) AS term FROM benchmark),
qsizes AS (SELECT query_id, count(*) AS n_words FROM qwords GROUP BY 1),
qw AS (
  SELECT query_id, bucket, (sum(idf) / any_value(n_words))::FLOAT::DOUBLE AS w
  FROM qwords JOIN terms USING (term) JOIN qsizes USING (query_id) GROUP BY 1, 2),
dots AS (SELECT query_id, doc_id, sum(qw.w * cw.w) AS dot FROM qw JOIN cw USING (bucket) GROUP BY 1, 2),
cn AS (SELECT d.doc_id, coalesce(sum(w * w), 0) AS n2 FROM documents d LEFT JOIN cw USING (doc_id) GROUP BY 1),
qn AS (SELECT b.item_id AS query_id, coalesce(sum(w * w), 0) AS n2 FROM benchmark b LEFT JOIN qw ON qw.query_id = b.item_id GROUP BY 1),
pairs AS (
  SELECT query_id, doc_id, round(abs(qn.n2 + cn.n2 - 2 * coalesce(dot, 0)), 6) AS d2,
         CASE WHEN qn.n2 > 0 AND cn.n2 > 0 THEN round(coalesce(dot, 0) / (sqrt(qn.n2) * sqrt(cn.n2)), 6) END AS cosine
  FROM qn CROSS JOIN cn LEFT JOIN dots USING (query_id, doc_id))"""


LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = {"ा": "A", "े": "e", "ि": "i", "ो": "o", "ु": "u"}
CONSONANTS = {
    "क": "k", "ग": "g", "च": "ch", "ज": "j", "त": "t", "द": "d", "न": "n", "प": "p", "ब": "b", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "स": "s", "ह": "h",
}


def romanized() -> str:
    """Each consonant with an inherent vowel, which a following vowel sign takes away."""
    text = "translate(lower(text), 'aeioukgcjtdnpbmyrlvsh', 'ाेिोुकगचजतदनपबमयरलवसह')"
    for letter, latin in CONSONANTS.items():
        text = f"replace({text}, '{letter}', '{latin}\x01')"
    text = f"regexp_replace({text}, '\x01([ाेिोु])', '\\1', 'g')"
    for sign, latin in {**SIGNS, "\x01": "a"}.items():
        text = f"replace({text}, '{sign}', '{latin}')"
    return text


NATION_TEXTS = """
texts AS (
  SELECT c_custkey::BIGINT AS query_id, 'schemes in nation_' || c_nationkey || ' for ' || lower(c_mktsegment) AS text FROM customer
  UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations)"""

LINKS = f"list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda t: {plain('t')})"

CARD_FIELDS = f"{squash(FIRST_LINE)} AS name, source AS facet, {squash('text')} AS description"

ORACLES: dict[str, str] = {
    "knn_l2": f"{HITS} SELECT query_id, rank, doc_id, score AS d2, round(sqrt(score), 4) AS distance FROM ranked WHERE metric = 'l2'",
    "knn_cosine": f"{HITS} SELECT query_id, rank, doc_id, score AS similarity FROM ranked WHERE metric = 'cosine'",
    "knn_small_vectors": """WITH
        q AS (SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x: x * 0.001::DOUBLE) AS v FROM embeddings),
        c AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7) * 0.001::DOUBLE) AS v FROM embeddings),
        pairs AS (SELECT query_id, doc_id, power(list_distance(q.v, c.v), 2) AS d2 FROM q CROSS JOIN c),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, doc_id) AS rank FROM pairs)
        SELECT query_id, rank::INTEGER AS rank, doc_id, round(d2 * 1e6, 4) AS d2_millionths FROM ranked WHERE rank <= 10""",
    "knn_l2_block": f"{HITS} SELECT query_id, rank, doc_id, score AS d2 FROM ranked WHERE metric = 'l2'",
    "knn_single": f"""WITH {C},
        spread AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c),
        means AS (SELECT pos, avg(x) AS x FROM spread GROUP BY pos),
        centre AS (SELECT list(x ORDER BY pos) AS v FROM means)
        SELECT doc_id, round(power(list_distance(c.v, centre.v), 2), 6) AS score FROM c, centre ORDER BY score, doc_id LIMIT 10""",
    "knn_materialize": f"""{HITS} SELECT query_id, metric, rank, doc_id, score, {FIRST_LINE} AS name, source AS facet, text AS description
        FROM ranked JOIN documents USING (doc_id)""",
    "display_rows": f"""{HITS} SELECT query_id, metric, rank, doc_id, {FIRST_LINE} AS name,
        coalesce(nullif(source, 'src7'), 'N/A') AS facet, 'S' || nullif(source, 'src7')[2:] AS facet_title, text AS description,
        lang || ', ' || source AS tags, printf('%.4f', score) AS score_text FROM ranked JOIN documents USING (doc_id)""",
    "vectors_normalized": f"""WITH {C}, s AS (SELECT doc_id, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS pos,
        sqrt(list_inner_product(v, v)) AS norm FROM c) SELECT doc_id, pos, round(x / norm, 6) AS unit_value FROM s""",
    "vectors_partitioned": f"""WITH {C}, f AS (SELECT doc_id, v::FLOAT[]::DOUBLE[] AS v FROM c)
        SELECT f.doc_id, source AS facet, len(v)::INTEGER AS dim, round(sqrt(list_inner_product(v, v)), 4) AS norm
        FROM f LEFT JOIN documents USING (doc_id)""",
    "vectors_stored": f"""WITH {C}, f AS (SELECT doc_id, v::FLOAT[]::DOUBLE[] AS v FROM c)
        SELECT f.doc_id, source AS facet, len(v)::INTEGER AS dim, round(sqrt(list_inner_product(v, v)), 4) AS norm
        FROM f LEFT JOIN documents USING (doc_id)""",
    "vectors_stored_keyless": f"""WITH {C} SELECT doc_id, len(v)::INTEGER AS dim FROM c WHERE doc_id % 10 <> 3
        UNION ALL SELECT NULL, max(len(v))::INTEGER FROM c WHERE doc_id % 10 = 3""",
    "resource_shared": f"""WITH {C}, f AS (SELECT doc_id, v::FLOAT[]::DOUBLE[] AS v FROM c)
        SELECT reader::INTEGER AS reader, source AS facet, count(*) AS n, round(sum(sqrt(list_inner_product(v, v))), 3) AS length, 1 AS builds
        FROM f LEFT JOIN documents USING (doc_id), range(2) t(reader) GROUP BY ALL""",
    "vector_stats": f"""WITH {C}, m AS (SELECT len(v)::INTEGER AS dim, sqrt(list_inner_product(v, v)) AS norm FROM c)
        SELECT count(*) AS n_rows, count(dim) AS n_vectors, count(*) FILTER (norm = 0) AS n_zero, min(dim) AS min_dim,
        max(dim) AS max_dim, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm FROM m""",
    "corpus_mapping": f"""SELECT doc_id, source AS facet, {FIRST_LINE} AS name, text AS description, lang || ', ' || source AS tags,
        {clean_index(FIRST_LINE)} || ' ' || {clean_index('text')} || ' ' || {clean_index("(lang || ', ' || source)")} AS combined_text
        FROM documents""",
    "corpus_preview": f"""SELECT doc_id, {FIRST_LINE} AS name, source AS facet, text AS description FROM documents ORDER BY doc_id LIMIT 5""",
    "column_profile": """WITH d AS (SELECT doc_id, text, lang, nullif(source, 'src7') AS source, n_chars FROM documents),
        n AS (SELECT count(*) AS rows, count(doc_id) AS a, count(text) AS b, count(lang) AS c, count(source) AS d, count(n_chars) AS e FROM d)
        SELECT 0 AS position, 'doc_id' AS column_name, 'bigint' AS data_type, rows, a AS non_null FROM n
        UNION ALL SELECT 1, 'text', 'string', rows, b FROM n UNION ALL SELECT 2, 'lang', 'string', rows, c FROM n
        UNION ALL SELECT 3, 'source', 'string', rows, d FROM n UNION ALL SELECT 4, 'n_chars', 'bigint', rows, e FROM n""",
    "records_csv": f"SELECT {FIRST_LINE} AS name, source AS state, text AS description, lang || ', ' || source AS tags FROM documents",
    "pages_extract_fields": f"""SELECT page_id, url,
        {plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        {plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
        trim(regexp_replace({plain("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')")},
             '{SPACE}', ' ', 'g')) AS body FROM pages""",
    "pages_extract_links": f"""WITH l AS (SELECT page_id, {LINKS} AS links FROM pages)
        SELECT page_id, unnest(range(1, len(links) + 1))::INTEGER AS link_no, unnest(links) AS link_text FROM l""",
    "cards_extract": f"""SELECT -1 - doc_id AS page_id, 1::INTEGER AS card_no, {CARD_FIELDS}, lang || '|' || source AS tags, false AS corrupt FROM documents
        UNION ALL SELECT -1 - doc_id, 2, lang, '', '', '', false FROM documents WHERE doc_id % 3 = 0""",
    "clean_query_text": f"SELECT doc_id, {clean_query('text')} AS cleaned FROM documents",
    "clean_index_text": f"SELECT doc_id, {clean_index('text')} AS cleaned FROM documents",
    "combined_text": f"""SELECT doc_id, {clean_query(FIRST_LINE)} || ' ' || {clean_query('text')} || ' ' ||
        {clean_query("(lang || ', ' || source)")} AS combined_text FROM documents""",
    "romanize": f"SELECT doc_id, {romanized()} AS romanized FROM documents",
    "tags_parse": f"""WITH l AS (SELECT page_id, {LINKS} AS links FROM pages)
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'no list [' || array_to_string(list_transform(links,
                 lambda t: '''' || regexp_replace(' ' || t, '([\\\\''])', '\\\\\\1', 'g') || ''''), ', ') || ']'
               ELSE array_to_string(list_filter(links, lambda t: t <> ''), ', ') END AS tags FROM l""",
    "query_nonblank": """WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' WHEN turn % 3 = 2 THEN ' ' || text ELSE text END AS text FROM conversations)
        SELECT * FROM b WHERE trim(text) <> ''""",
    "facet_filter": """WITH d AS (SELECT doc_id, nullif(source, 'src17') AS facet FROM documents)
        SELECT * FROM d WHERE lower(facet) = 'src5' OR contains(lower(facet), 'src1')""",
    "facet_values": """SELECT 'All States' AS option, 0 AS section UNION ALL
        SELECT DISTINCT source, 1 FROM documents WHERE source <> 'src7'""",
    "facet_detect": f"""WITH {NATION_TEXTS}
        SELECT query_id, min_by(n_name, n_nationkey) AS detected_facet
        FROM texts LEFT JOIN nation ON contains(lower(text), lower(n_name)) GROUP BY query_id""",
    "facet_detect_passages": """SELECT d.doc_id AS query_id, min_by(b.text, b.item_id) AS detected_facet
        FROM documents d LEFT JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY d.doc_id""",
    "facet_resolve": f"WITH {FACET_QUERIES} SELECT * FROM resolved",
    "facet_title": f"""SELECT p_partkey, {title("(p_name || ' ' || lower(p_type) || ' o''' || p_name)")} AS title FROM part""",
    "search_filtered": f"{FILTERED} {FOUND}",
    "search_fallback": compared(
        """SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'src99' WHEN vec_id % 3 = 1 THEN 'src' || (vec_id % 20) END AS facet_used
           FROM embeddings""", "false", 10, 1) + FOUND,
    "search_prefilter": compared(RESOLVED_USED, "false", 10, None) + FOUND,
    "search_prefilter_fallback": compared(
        """SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'src99' WHEN vec_id % 3 = 1 THEN 'SRC' || (vec_id % 20) END AS facet_used
           FROM embeddings""", ALWAYS_SRC1, 10, None) + FOUND,
    "search_bucketed": positioned("cost"),
    "search_order_reference": positioned("score DESC"),
    "compare_metrics": f"""{HITS},
        lists AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (metric = 'l2') AS l2, list(doc_id ORDER BY rank) FILTER (metric = 'cosine') AS cs,
          min(score) FILTER (metric = 'l2') AS l2_min, max(score) FILTER (metric = 'l2') AS l2_max,
          min(score) FILTER (metric = 'cosine') AS cosine_min, max(score) FILTER (metric = 'cosine') AS cosine_max FROM ranked GROUP BY query_id),
        merged AS (SELECT *, list_sort(list_intersect(l2, cs)) AS common FROM lists)
        SELECT query_id, array_to_string(l2, ',') AS l2_ids, array_to_string(cs, ',') AS cosine_ids, l2_min, l2_max, cosine_min, cosine_max,
          coalesce(array_to_string(common, ','), '') AS common_ids, len(common)::INTEGER AS common_count, len(common) / 10.0::DOUBLE AS common_share FROM merged""",
    "compare_aligned": f"""{HITS}
        SELECT query_id, doc_id, a.rank AS l2_rank, b.rank AS cosine_rank, a.score AS l2_score, b.score AS cosine_score, b.rank - a.rank AS rank_change
        FROM (SELECT * FROM ranked WHERE metric = 'l2') a FULL JOIN (SELECT * FROM ranked WHERE metric = 'cosine') b USING (query_id, doc_id)""",
    "compare_names": f"""{HITS}, named AS (SELECT query_id, metric, {FIRST_LINE} AS name FROM ranked JOIN documents USING (doc_id)),
        lists AS (SELECT query_id, list(DISTINCT name) FILTER (metric = 'l2') AS l2, list(DISTINCT name) FILTER (metric = 'cosine') AS cs,
          count(*) FILTER (metric = 'l2') AS l2_count FROM named GROUP BY query_id),
        merged AS (SELECT *, list_sort(list_intersect(l2, cs)) AS common FROM lists)
        SELECT query_id, l2_count, coalesce(array_to_string(common, '|'), '') AS common_names, len(common)::INTEGER AS common_count,
          len(common)::DOUBLE / l2_count AS common_share FROM merged""",
    "embed_tfidf": f"WITH {tfidf(clean_index)} SELECT doc_id, bucket::INTEGER AS bucket, round(w, 4) AS weight FROM cw WHERE w <> 0",
    "embed_tfidf_rare_terms": f"WITH {tfidf(clean_index)} SELECT doc_id, bucket::INTEGER AS bucket, round(w, 4) AS weight FROM cw WHERE w <> 0",
    "embed_encoder": f"""WITH t AS (SELECT doc_id, {clean_query('text')} AS t FROM documents)
        SELECT doc_id, pos::INTEGER AS pos, (len(t) - len(replace(t, chr((97 + pos)::INTEGER), '')))::DOUBLE AS n FROM t, range(26) r(pos)""",
    "search_text_l2": f"""WITH {text_pairs(clean_index)}, {ranked(10)}
        SELECT query_id, metric, rank, doc_id, score FROM ranked WHERE metric = 'l2'""",
    "search_text_stored": f"""WITH {text_pairs(clean_index)}, {ranked(10)}
        SELECT query_id, rank, doc_id, score AS similarity, {FIRST_LINE} AS name, source AS facet
        FROM ranked JOIN documents USING (doc_id) WHERE metric = 'cosine'""",
    "search_text_compare": compared(
        """SELECT item_id AS query_id, min(source) AS facet_used FROM benchmark
           LEFT JOIN (SELECT DISTINCT source FROM documents) ON contains(lower(benchmark.text || ' src' || (item_id % 23)), source) GROUP BY 1""",
        ALWAYS_SRC1, 10, 10, text_pairs(clean_query)) + f""",
        b AS (SELECT *, {BUCKET} AS bucket FROM found),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, metric ORDER BY bucket, cost, doc_id)::INTEGER AS position FROM b)
        SELECT query_id, metric, position, bucket, rank, doc_id, score, {FIRST_LINE} AS name, facet, facet_used, fallback_used
        FROM p JOIN documents USING (doc_id)""",
    "stream_search": f"{HITS} SELECT query_id, rank, doc_id, score AS d2 FROM ranked WHERE metric = 'l2'",
}
