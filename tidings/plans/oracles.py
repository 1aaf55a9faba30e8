"""SQL that computes the registered queries independently, for DuckDB.

The SQL works on exploded tokens and vector components, so it shares no formulation with
the Spark plans. Queries whose result depends on a random fit are absent.
"""

from __future__ import annotations

from tidings.functions.text import DEFAULT_STOP_WORDS
from tidings.plans.catalog import COST_TIME, KEEP_NEWEST, NOVEL_LEVEL1, NOVEL_LEVEL2

_STOP = ", ".join("'" + word.replace("'", "''") + "'" for word in DEFAULT_STOP_WORDS)
_SPACE = r" \t\n\x0b\f\r"


def _clean(column: str) -> str:
    kept = f"regexp_replace({column}, '[^a-zA-Z0-9{_SPACE}]', '', 'g')"
    longer = rf"regexp_replace({kept}, '\b[a-zA-Z]{{1,2}}\b', '', 'g')"
    return f"regexp_replace({longer}, '[{_SPACE}]+', ' ', 'g')"


def _clean_lda(column: str) -> str:
    single = f"regexp_replace(lower({column}), '[{_SPACE}]+', ' ', 'g')"
    letters = f"regexp_replace({single}, '[^a-zA-Z ]', '', 'g')"
    return rf"regexp_replace({letters}, '\b[a-zA-Z]{{1,2}}\b', '', 'g')"


def _split(column: str) -> str:
    """Blank-separated words; trailing empty ones go, blanks alone give none."""
    return (
        f"CASE WHEN length({column}) > 0 AND rtrim({column}) = '' THEN []::VARCHAR[] "
        f"ELSE string_split(rtrim({column}), ' ') END"
    )


def _content(column: str) -> str:
    """Words of a blank-separated string that are no stop words, each with a blank."""
    kept = f"list_filter({_split(column)}, lambda w: w NOT IN ({_STOP}))"
    return (
        f"CASE WHEN len({kept}) = 0 THEN '' "
        f"ELSE array_to_string({kept}, ' ') || ' ' END"
    )


_STAMP = "TIMESTAMP '2024-01-01' + to_minutes(doc_id)"
_DIGITS = f"strftime({_STAMP}, '%Y%m%d%H%M%S')"

_CLEANED = f"cleaned AS (SELECT *, {_clean('text')} AS c FROM documents)"
_LDA = f"cleaned AS (SELECT *, {_clean_lda('text')} AS c FROM documents)"


def _tokens(source: str, column: str, stop: bool) -> str:
    """Exploded lower-case tokens of ``source.column``: doc_id, pos, token."""
    where = f"WHERE token NOT IN ({_STOP})" if stop else ""
    return f"""
        split AS (SELECT doc_id, {_split(f'lower({column})')} AS w FROM {source}),
        placed AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS spot FROM split),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS pos
                 FROM placed {where})
    """


_TOKEN_ROWS = "SELECT doc_id, pos, token FROM kept"

# words of every document: cleaned, lower-cased, without stop words
_WORDS = f"""
    {_CLEANED},
    split AS (SELECT doc_id, lang, source, {_split("lower(trim(c))")} AS w FROM cleaned),
    docs AS (SELECT doc_id, lang, source,
                    list_filter(w, lambda x: x NOT IN ({_STOP})) AS words FROM split),
    tok AS (SELECT doc_id, lang, source, unnest(words) AS term FROM docs)
"""


def _ranked(groups: str, size: str, floor: str, name: str = "") -> str:
    """Term counts, group sizes and the vocabulary by group, as CTEs with a suffix."""
    on = " AND ".join(f"t.{g} IS NOT DISTINCT FROM s.{g}" for g in groups.split(", "))
    return f"""
    sizes{name} AS (SELECT {groups}, count(*) AS m,
                    floor(avg(len(list_distinct(words)))) AS v,
                    count(*) // 5 AS lowest FROM docs GROUP BY {groups}),
    counts{name} AS (SELECT {groups}, term, count(*) AS n,
                     count(DISTINCT doc_id) AS df FROM tok GROUP BY {groups}, term),
    known{name} AS (SELECT t.*, s.m, s.v FROM counts{name} t JOIN sizes{name} s ON {on}
                    WHERE t.df >= {floor}),
    ranked{name} AS (SELECT *, row_number() OVER (
                         PARTITION BY {groups} ORDER BY n DESC, term) - 1 AS rank
                     FROM known{name}),
    vocab{name} AS (SELECT *, ln((m + 1) / (df + 1)) AS idf FROM ranked{name}
                    WHERE rank < {size})
    """


def _labelled(groups: str, length: int, name: str = "") -> str:
    on = " AND ".join(f"l.{g} IS NOT DISTINCT FROM s.{g}" for g in groups.split(", "))
    picked = ", ".join(f"s.{g}" for g in groups.split(", "))
    return f"""
    best{name} AS (SELECT *, row_number() OVER (
                       PARTITION BY {groups} ORDER BY idf DESC, rank) AS place FROM vocab{name}),
    joined{name} AS (SELECT {groups}, string_agg(term, ' ' ORDER BY place) AS label
                     FROM best{name} WHERE place <= {length} GROUP BY {groups}),
    labels{name} AS (SELECT {picked}, s.m AS documents, coalesce(l.label, '') AS label
                     FROM sizes{name} s LEFT JOIN joined{name} l ON {on})
    """


# the 100 most frequent terms of at least 5 documents, over all documents
_GLOBAL = f"""
    {_WORDS},
    counts AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank
               FROM counts WHERE df >= 5),
    vocab AS (SELECT *, ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) AS idf
              FROM ranked WHERE rank < 100),
    weights AS (SELECT doc_id, t.term, count(*) AS tf, any_value(idf) AS idf
                FROM tok t JOIN vocab v ON t.term = v.term GROUP BY doc_id, t.term)
"""

_ARTICLES = f"""
    written AS (
        SELECT doc_id,
               'Timestamp: ' || CASE WHEN lang = 'de' THEN 'unknown' ELSE {_DIGITS} END
               || chr(10) || 'Title: '
               || CASE WHEN lang = 'fr' THEN source || ': ' || lang ELSE source END
               || chr(10) || 'Text: '
               || CASE WHEN lang = 'es' THEN chr(10) ELSE '' END || text AS value
        FROM documents),
    lines AS (SELECT doc_id, string_split(rtrim(value, chr(10)), chr(10)) AS l FROM written)
"""

# the first ': ' ends the header; an empty header leaves the lines below
_REPAIRED = f"""
    {_ARTICLES},
    parsed AS (
        SELECT doc_id,
               strftime(try_strptime(substr(l[1], 12), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS ts,
               substr(l[2], 8) AS title,
               array_to_string(
                   CASE WHEN substr(l[3], 7) = '' THEN l[4:] ELSE [substr(l[3], 7)] || l[4:] END,
                   ' ') AS text
        FROM lines)
"""

# exactly one ': ' in a header, apart from trailing ones, or the word error
_STRICT = f"""
    {_ARTICLES},
    heads AS (
        SELECT doc_id, l, [string_split(regexp_replace(x, '(: )+$', ''), ': ') FOR x IN l[1:3]] AS h
        FROM lines),
    parsed AS (
        SELECT doc_id,
               strftime(try_strptime(CASE WHEN len(h[1]) = 2 THEN h[1][2] END, '%Y%m%d%H%M%S'),
                        '%Y-%m-%d %H:%M:%S') AS ts,
               CASE WHEN len(h[2]) = 2 THEN h[2][2] ELSE 'error' END AS title,
               array_to_string(
                   [CASE WHEN len(h[3]) = 2 THEN h[3][2] ELSE 'error' END] || l[4:], ' ') AS text
        FROM heads)
"""

_TAGGED = f"""
    {_CLEANED},
    tagged AS (
        SELECT doc_id, '<timestamp>' || strftime({_STAMP}, '%Y-%m-%d %H:%M:%S') || '</timestamp>'
               || '<title>' || source || '</title><content>' || c || '</content>' AS line
        FROM cleaned)
"""

_EXPORT = """
    lines AS (
        SELECT vec_id, 'topic' || repeat('x', label * 3) AS labels,
               CAST(CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) || ','
               || CAST(CAST(floor(CAST(embedding[2] AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)
               AS vectors
        FROM embeddings),
    terms AS (SELECT DISTINCT 'topic' || repeat('x', label * 6) AS term FROM embeddings)
"""

_VECTORS = """
    parts AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster,
                     CASE WHEN embedding[1] < 0 THEN 0 ELSE 1 END AS side,
                     CAST(unnest(embedding) AS DOUBLE) AS v,
                     generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
    centres AS (SELECT cluster, dim, avg(v) AS c FROM parts GROUP BY cluster, dim)
"""

_NEAREST = f"""
    {_VECTORS},
    apart AS (SELECT p.vec_id, c.cluster, sum((v - c) * (v - c)) AS distance
              FROM parts p JOIN centres c ON p.dim = c.dim GROUP BY p.vec_id, c.cluster),
    near AS (SELECT vec_id, cluster, distance FROM apart QUALIFY row_number() OVER (
                 PARTITION BY vec_id ORDER BY distance, cluster) = 1)
"""

_TWO_LEVELS = f"""
    {_NEAREST},
    subcentres AS (SELECT cluster, side, dim, avg(v) AS c FROM parts GROUP BY cluster, side, dim),
    subapart AS (SELECT p.vec_id, n.cluster, n.distance, s.side AS subcluster,
                        sum((p.v - s.c) * (p.v - s.c)) AS subdistance
                 FROM near n JOIN parts p ON n.vec_id = p.vec_id
                 JOIN subcentres s ON s.cluster = n.cluster AND s.dim = p.dim
                 GROUP BY ALL),
    placed AS (SELECT * FROM subapart QUALIFY row_number() OVER (
                   PARTITION BY vec_id ORDER BY subdistance, subcluster) = 1)
"""

_SLICED = "seqs AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events)"

ORACLES: dict[str, str] = {
    "article_fields": f"""
        WITH {_REPAIRED}
        SELECT doc_id, ts, title, text,
               CASE WHEN ts IS NULL THEN 'bad_timestamp' END AS reject_reason FROM parsed
    """,
    "article_fields_strict": f"""
        WITH {_STRICT}
        SELECT doc_id, ts, title, text,
               CASE WHEN ts IS NULL THEN 'bad_timestamp' END AS reject_reason FROM parsed
    """,
    "article_ts": f"""
        SELECT doc_id, CASE WHEN lang IN ('en', 'fr')
                            THEN strftime({_STAMP}, '%Y-%m-%d %H:%M:%S') END AS ts
        FROM documents
    """,
    "article_valid": f"""
        WITH {_REPAIRED} SELECT doc_id, ts, title FROM parsed WHERE ts IS NOT NULL
    """,
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "clean_text_lda": f"SELECT doc_id, {_clean_lda('text')} AS cleaned FROM documents",
    "stopwords_string": f"WITH {_CLEANED} SELECT doc_id, {_content('c')} AS content FROM cleaned",
    "tokens": f"WITH {_CLEANED}, {_tokens('cleaned', 'c', False)} {_TOKEN_ROWS}",
    "stopwords_tokens": f"WITH {_CLEANED}, {_tokens('cleaned', 'c', True)} {_TOKEN_ROWS}",
    "stopwords_default": f"""
        WITH {_CLEANED},
        placed AS (SELECT doc_id, unnest(string_split(trim(c), ' ')) AS token,
                          generate_subscripts(string_split(trim(c), ' '), 1) AS spot FROM cleaned),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS pos
                 FROM placed WHERE lower(token) NOT IN ({_STOP}))
        {_TOKEN_ROWS}
    """,
    "token_counts": f"""
        WITH {_CLEANED}, {_tokens('cleaned', 'c', False)}
        SELECT s.doc_id, count(token) AS total_words, count(DISTINCT token) AS distinct_words
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id GROUP BY s.doc_id
    """,
    "tagged_format": f"WITH {_TAGGED} SELECT doc_id, line FROM tagged",
    "tagged_fields": f"""
        WITH {_CLEANED}
        SELECT doc_id, strftime({_STAMP}, '%Y-%m-%d %H:%M:%S') AS timestamp, source AS title,
               trim(c) AS content FROM cleaned
    """,
    "stream_tokens": f"""
        WITH {_TAGGED},
        contents AS (SELECT doc_id, trim(regexp_extract(line, '<content>(.*)</content>', 1)) AS t
                     FROM tagged),
        {_tokens('contents', 't', True)} {_TOKEN_ROWS}
    """,
    "preprocess_articles": f"""
        WITH {_REPAIRED},
        cleaned AS (SELECT *, {_clean("title || ' ' || text")} AS c FROM parsed
                    WHERE ts IS NOT NULL)
        SELECT CAST(doc_id AS VARCHAR) AS doc_id,
               '<timestamp>' || ts || '</timestamp><title>' || title || '</title><content>'
               || {_content('c')} || '</content>' AS line
        FROM cleaned
    """,
    "articles_sorted": f"""
        WITH {_REPAIRED}
        SELECT row_number() OVER (ORDER BY ts, doc_id) - 1 AS rank, doc_id, ts
        FROM parsed WHERE ts IS NOT NULL
    """,
    "lemma_normalise": f"""
        WITH {_CLEANED},
        split AS (SELECT doc_id, {_split("lower(trim(c))")} AS w FROM cleaned),
        placed AS (SELECT doc_id, unnest(w) AS form, generate_subscripts(w, 1) AS spot FROM split),
        lemmas AS (SELECT doc_id, spot, CASE WHEN length(form) > 5
                       THEN regexp_replace(form, '(ing|ed|s)$', '') ELSE form END AS lemma
                   FROM placed),
        kept AS (SELECT doc_id, string_agg(lower(lemma), ' ' ORDER BY spot) AS content FROM lemmas
                 WHERE length(lemma) > 2 AND lemma NOT IN ({_STOP}) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.content, '') AS content
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "strip_export": f"WITH {_EXPORT} SELECT vec_id, labels, vectors FROM lines",
    "positional_join": f"""
        WITH {_EXPORT}
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, labels, vectors FROM lines
    """,
    "vocab_semi_join": f"""
        WITH {_EXPORT} SELECT vec_id, labels FROM lines WHERE labels IN (SELECT term FROM terms)
    """,
    "export_finish": f"""
        WITH {_EXPORT},
        placed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, labels, vectors FROM lines)
        SELECT id, labels, vectors FROM placed
        WHERE length(labels) < 25 AND labels IN (SELECT term FROM terms)
    """,
    "adaptive_params": f"""
        WITH {_WORDS}
        SELECT lang, count(*) AS documents,
               CAST(floor(avg(len(list_distinct(words)))) AS BIGINT) AS vocab_size,
               count(*) // 5 AS min_df FROM docs GROUP BY lang
    """,
    "vocabulary": f"WITH {_GLOBAL} SELECT rank, term, n, df, round(idf, 6) AS idf FROM vocab",
    "vocabulary_by_group": f"""
        WITH {_WORDS}, {_ranked('source', 'v', 's.lowest')}
        SELECT source, rank, term, n, df, round(idf, 6) AS idf FROM vocab
    """,
    "doc_term_tf": f"WITH {_GLOBAL} SELECT doc_id, term, tf FROM weights",
    "doc_term_tfidf": f"""
        WITH {_GLOBAL}
        SELECT doc_id, term, tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf FROM weights
    """,
    "nonzero_docs": f"""
        WITH {_GLOBAL}
        SELECT DISTINCT doc_id FROM tok
        WHERE term IN (SELECT term FROM vocab WHERE rank < 3)
    """,
    "cluster_labels": f"""
        WITH {_WORDS}, {_ranked('lang', 'v', 's.lowest')}, {_labelled('lang', 5)}
        SELECT lang, documents, label FROM labels
    """,
    "cluster_labels_fixed": f"""
        WITH {_WORDS}, {_ranked('source', '20', '1')}, {_labelled('source', 4)}
        SELECT source, documents, label FROM labels
    """,
    "topic_pairs": f"""
        WITH {_WORDS},
        {_ranked('source', '20', '1', '1')}, {_labelled('source', 4, '1')},
        {_ranked('source, lang', '20', '1', '2')}, {_labelled('source, lang', 4, '2')}
        SELECT DISTINCT a.label AS "MainTopic", b.label AS "SubTopic"
        FROM labels1 a JOIN labels2 b ON a.source = b.source
    """,
    "cluster_sizes": """
        SELECT source, lang, count(*) AS documents FROM documents GROUP BY source, lang
    """,
    "centroids": f"WITH {_VECTORS} SELECT cluster, dim, round(c, 6) AS value FROM centres",
    "centroid_distance": f"""
        WITH {_VECTORS}
        SELECT p.vec_id, p.cluster, round(sum((v - c) * (v - c)), 6) AS distance
        FROM parts p JOIN centres c ON p.cluster = c.cluster AND p.dim = c.dim
        GROUP BY p.vec_id, p.cluster
    """,
    "nearest_centroid": f"""
        WITH {_NEAREST} SELECT vec_id, cluster, round(distance, 6) AS distance FROM near
    """,
    "novelty_split": f"""
        WITH {_NEAREST}
        SELECT vec_id, CASE WHEN distance > {NOVEL_LEVEL1} THEN 'novel' ELSE 'fitted' END AS fit
        FROM near
    """,
    "route_docs": f"""
        WITH {_TWO_LEVELS}
        SELECT vec_id, cluster, CAST(subcluster AS BIGINT) AS subcluster,
               CASE WHEN distance > {NOVEL_LEVEL1} THEN 'global'
                    WHEN subdistance > {NOVEL_LEVEL2} THEN 'local' ELSE 'warehouse' END AS slot
        FROM placed
    """,
    "cluster_cost": f"""
        WITH {_TWO_LEVELS},
        level1 AS (SELECT cluster, sum(distance) AS cost FROM placed GROUP BY cluster),
        level2 AS (SELECT cluster, subcluster, sum(subdistance) AS cost FROM placed
                   GROUP BY cluster, subcluster)
        SELECT '{COST_TIME}' AS "TimeStamp", a.cluster AS "firstLevelClusterIndex",
               round(a.cost, 6) AS "firstLevelClusterCost",
               CAST(b.subcluster AS BIGINT) AS "secondLevelClusterIndex",
               round(b.cost, 6) AS "secondLevelClusterCost"
        FROM level1 a JOIN level2 b ON a.cluster = b.cluster
    """,
    "replay_slices": f"""
        WITH {_SLICED}
        SELECT seq // 50 AS slice, count(*) AS rows, min(event_id) AS min_id,
               max(event_id) AS max_id FROM seqs GROUP BY seq // 50
    """,
    "replay_peek": f"""
        WITH {_SLICED}
        SELECT seq // 50 AS slice, event_id, event_type, value FROM seqs
        WHERE seq % 50 = 0 AND seq // 50 < (SELECT count(*) FROM events) // 50
    """,
    "retain_newest": f"""
        SELECT event_id, event_type AS cluster, user_id AS batch_id FROM events
        QUALIFY row_number() OVER (
            PARTITION BY event_type ORDER BY user_id DESC, event_id DESC) <= {KEEP_NEWEST}
    """,
    "union_slots": """
        SELECT event_id, 'global' AS slot FROM events WHERE event_type = 'error'
        UNION ALL
        SELECT event_id, 'warehouse' AS slot FROM events WHERE event_type <> 'error'
    """,
    # what holds for every fit, whatever its random start
    "kmeans_invariants": """
        SELECT 'documents' AS measure, count(DISTINCT doc_id) AS value FROM documents
        UNION ALL SELECT 'rows', count(*) FROM documents
        UNION ALL SELECT 'not_nearest', 0
        UNION ALL SELECT 'differs_when_reloaded', 0
        UNION ALL SELECT 'cost_is_off', 0
    """,
    "hierarchy_invariants": """
        SELECT 'documents_in_topics' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'missing_labels', 0
        UNION ALL SELECT 'documents_assigned', count(DISTINCT doc_id) FROM documents
    """,
    "lda_invariants": f"""
        WITH {_LDA},
        split AS (SELECT doc_id, {_split('c')} AS w FROM cleaned),
        tok AS (SELECT doc_id, unnest(w) AS term FROM split),
        kept AS (SELECT * FROM tok WHERE term NOT IN ({_STOP})),
        vocab AS (SELECT term FROM kept GROUP BY term ORDER BY count(*) DESC, term LIMIT 20),
        known AS (SELECT DISTINCT doc_id FROM kept WHERE term IN (SELECT term FROM vocab))
        SELECT 'documents' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'without_terms', count(*) FROM documents
                  WHERE doc_id NOT IN (SELECT doc_id FROM known)
        UNION ALL SELECT 'do_not_add_up', 0
    """,
    "word_vectors_words": f"WITH {_WORDS} SELECT DISTINCT term AS word FROM tok",
    "inspect_words": f"""
        WITH {_WORDS}
        SELECT 2 - grouping(source) - grouping(lang) AS level, lang AS cluster,
               source AS subcluster, term AS word, count(*) AS count
        FROM tok
        GROUP BY GROUPING SETS ((lang, source, term), (lang, term), (term))
    """,
    # fits that meet NULL and NaN input, and what holds for every fit
    "assign_with_gaps": """
        WITH parts AS (
            SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
                   generate_subscripts(embedding, 1) AS i FROM embeddings),
        centres AS (SELECT label AS c, i, avg(v) AS m FROM parts GROUP BY label, i),
        usable AS (SELECT * FROM parts WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0),
        met AS (SELECT vec_id, label, c, sum((v - m) * (v - m)) AS d
                FROM usable JOIN centres USING (i) GROUP BY vec_id, label, c),
        best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM met)
        SELECT e.vec_id, b.c::BIGINT AS nearest, round(b.d, 6) AS least, round(o.d, 6) AS own
        FROM embeddings e
        LEFT JOIN best b ON b.vec_id = e.vec_id AND b.place = 1
        LEFT JOIN met o ON o.vec_id = e.vec_id AND o.c = e.label AND e.label % 2 = 0
    """,
    "words_with_gaps": f"""
        WITH {_WORDS}
        SELECT 'documents' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'without_words', count(*) FROM docs
                  WHERE doc_id % 5 = 0 OR len(words) = 0
        UNION ALL SELECT 'without_cluster', 0
    """,
    "adaptive_fit_invariants": f"""
        WITH {_WORDS},
        size AS (SELECT count(*) // 5 AS lowest,
                        floor(avg(len(list_distinct(words)))) AS v FROM docs),
        counts AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term)
        SELECT 'documents' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'terms', least(
            (SELECT count(*) FROM counts, size WHERE df >= lowest), (SELECT v FROM size))::BIGINT
        UNION ALL SELECT 'not_a_cluster', 0
        UNION ALL SELECT 'negative_distance', 0
    """,
    "lda_topic_invariants": """
        SELECT 'topics' AS measure, 3 AS value
        UNION ALL SELECT 'terms_listed', 9
        UNION ALL SELECT 'other_terms', 0
        UNION ALL SELECT 'weights_rise', 0
    """,
    "lda_membership_invariants": f"""
        WITH {_LDA},
        split AS (SELECT doc_id, {_split('c')} AS w FROM cleaned),
        tok AS (SELECT doc_id, unnest(w) AS term FROM split),
        kept AS (SELECT * FROM tok WHERE term NOT IN ({_STOP})),
        vocab AS (SELECT term FROM kept GROUP BY term ORDER BY count(*) DESC, term LIMIT 20),
        known AS (SELECT DISTINCT doc_id FROM kept WHERE term IN (SELECT term FROM vocab))
        SELECT 'documents' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'differ', 0
        UNION ALL SELECT 'too_low', 0
        UNION ALL SELECT 'no_topic', count(*) FROM documents
                  WHERE doc_id NOT IN (SELECT doc_id FROM known)
    """,
    "lda_hierarchy_invariants": """
        SELECT 'topics' AS measure, 3 AS value
        UNION ALL SELECT 'subtopics', 6
        UNION ALL SELECT 'short_topics', 0
        UNION ALL SELECT 'short_subtopics', 0
    """,
    "pca_invariants": """
        SELECT 'rows' AS measure, count(*) AS value FROM embeddings
        UNION ALL SELECT 'correlated', 0
        UNION ALL SELECT 'second_is_wider', 0
        UNION ALL SELECT 'too_wide', 0
    """,
    # files written and read back
    "line_scan": rf"""
        SELECT row_number() OVER (ORDER BY {_STAMP}, doc_id) - 1 AS id,
               strftime({_STAMP}, '%Y-%m-%d %H:%M:%S') AS timestamp,
               source AS title,
               length(trim(regexp_replace(text, '[\s<>]+', ' ', 'g'))) AS content_chars
        FROM documents
    """,
    "export_scan": """
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id,
               'w' || lpad(vec_id::VARCHAR, 12, '0') AS labels,
               vec_id::VARCHAR || '.0,0.5' AS vectors
        FROM embeddings
    """,
    "article_scan": f"""
        WITH {_REPAIRED},
        cleaned AS (SELECT *, {_clean("title || ' ' || text")} AS c FROM parsed
                    WHERE ts IS NOT NULL)
        SELECT row_number() OVER (ORDER BY ts, doc_id) - 1 AS id, ts AS timestamp, title,
               trim({_content('c')}) AS content
        FROM cleaned
    """,
    "topic_tables": f"""
        WITH {_WORDS},
        {_ranked('source', '20', '1', '1')}, {_labelled('source', 4, '1')},
        {_ranked('source, lang', '20', '1', '2')}, {_labelled('source, lang', 4, '2')},
        listed AS (SELECT b.source, b.lang, a.label || '|' || b.label AS label,
                          (SELECT count(*) FROM documents d
                           WHERE d.source = b.source AND d.lang = b.lang) AS documents
                   FROM labels1 a JOIN labels2 b ON a.source = b.source)
        SELECT 'topics' AS part, source AS a, lang AS b, label, documents::DOUBLE AS value FROM listed
        UNION ALL SELECT DISTINCT 'pairs', '', '', label, 0.0 FROM listed
        UNION ALL SELECT 'costs', "firstLevelClusterIndex"::VARCHAR, "secondLevelClusterIndex"::VARCHAR,
               "TimeStamp", round("firstLevelClusterCost" + "secondLevelClusterCost", 5) FROM costs
    """,
    "lda_reload": f"""
        WITH {_LDA},
        split AS (SELECT doc_id, {_split('c')} AS w FROM cleaned),
        tok AS (SELECT doc_id, unnest(w) AS term FROM split),
        kept AS (SELECT * FROM tok WHERE term NOT IN ({_STOP})),
        vocab AS (SELECT term FROM kept GROUP BY term ORDER BY count(*) DESC, term LIMIT 20)
        SELECT 'only_fitted_or_only_applied' AS measure, 0 AS value
        UNION ALL SELECT 'apart', 0
        UNION ALL SELECT 'topics', 3
        UNION ALL SELECT 'without_subtopics', 0
        UNION ALL SELECT 'do_not_add_up', 0
        UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM kept
                  WHERE term IN (SELECT term FROM vocab)
    """,
    "export_map": """
        SELECT 'labels' AS measure, count(*) AS value FROM embeddings
        UNION ALL SELECT 'positions', count(*) FROM embeddings
        UNION ALL SELECT 'unmatched', 0
        UNION ALL SELECT 'moved', 0
        UNION ALL SELECT 'flat', 0
    """,
    "stream_conservation": """
        SELECT 'documents' AS measure, count(*) AS value FROM documents
        UNION ALL SELECT 'in_boot', 0
        UNION ALL SELECT 'without_cluster', 0
        UNION ALL SELECT 'first_fit', 0
    """,
    # five batches of b documents: the second fills a container of 100, the third one of two
    "stream_refits": """
        WITH fills AS (SELECT count(*) AS n, (count(*) + 4) // 5 AS b FROM documents)
        SELECT 'documents' AS measure, n AS value FROM fills
        UNION ALL SELECT 'global_refits', CASE WHEN b >= 100 THEN 1 ELSE 0 END FROM fills
        UNION ALL SELECT 'global_used', CASE WHEN b >= 100 THEN b ELSE 0 END FROM fills
        UNION ALL SELECT 'global_held_last', CASE WHEN b >= 100 THEN 0 ELSE b END FROM fills
        UNION ALL SELECT 'some_local_refit', CASE WHEN b >= 199 THEN 1 ELSE 0 END FROM fills
        UNION ALL SELECT 'containers_left_full', 0
        UNION ALL SELECT 'warehouses_over', 0
        UNION ALL SELECT 'without_cluster', 0
        UNION ALL SELECT 'keys_twice', 0
    """,
    "stream_bootstrap": """
        WITH size AS (SELECT count(*) AS n, (count(*) + 2) // 3 AS b FROM documents)
        SELECT 0 AS behind, 'boot' AS slot, b AS documents, -1::BIGINT AS version FROM size
        UNION ALL SELECT 1, 'placed', 2 * b, 1 FROM size
        UNION ALL SELECT 2, 'placed', n, 1 FROM size
    """,
    "topic_views": f"""
        WITH {_WORDS},
        sizes AS (SELECT source, count(*) AS documents, sum(len(words))::BIGINT AS tokens
                  FROM docs GROUP BY source),
        counts AS (SELECT source, term, count(*) AS n FROM tok GROUP BY source, term),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS place
                   FROM counts)
        SELECT s.source, s.documents, s.tokens, count(*) AS terms,
               max(CASE WHEN place = 1 THEN term END) AS best
        FROM sizes s JOIN ranked r ON r.source = s.source AND place <= 20
        GROUP BY s.source, s.documents, s.tokens
    """,
    "stream_resume": """
        SELECT doc_id::VARCHAR AS key, 'placed' AS slot, 1 AS times, 1 AS clusters
        FROM documents
    """,
}

ORACLES["topic_tables"] = ORACLES["topic_tables"].replace(
    "listed AS (", f"costs AS ({ORACLES['cluster_cost']}),\n        listed AS (", 1
)
ORACLES["vocabulary_sink"] = (
    f"SELECT term, count(*) AS groups FROM ({ORACLES['vocabulary_by_group']}) GROUP BY term"
)
