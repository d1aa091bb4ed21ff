"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


WHITE = r"[\s\x{b}\x{1c}-\x{1f}\p{Z}\x{85}]"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH c AS (SELECT DISTINCT id, text_content AS t FROM chunks WHERE id IS NOT NULL AND length(text_content) >= 200),
            w AS (SELECT id, substr(t, i, 200) AS s FROM c, unnest(range(1, length(t) - 198)) AS u(i)),
            m AS (SELECT s FROM w GROUP BY s HAVING min(id) <> max(id))
            SELECT DISTINCT id AS chunk_id FROM w JOIN m USING (s)""",
        "p3_found": """
            WITH latest AS (SELECT id, max(struct_pack(f := coalesce(finished_at, TIMESTAMP '0001-01-01'), v := vector)).v AS v FROM embedresult GROUP BY id),
            fine AS (SELECT id, v::DOUBLE[] AS v FROM latest WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
            tracked AS (SELECT DISTINCT chunk_id AS id, collection FROM chunk_vectors WHERE collection IS NOT NULL),
            rows AS (SELECT collection, id, v FROM fine JOIN tracked USING (id)),
            ranked AS (
              SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s,
                     row_number() OVER (PARTITION BY collection, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS n
              FROM rows a JOIN rows b USING (collection) WHERE a.id <> b.id)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM ranked WHERE n <= 5 AND s >= 0.9""",
        "p9_found": f"""
            WITH item AS (SELECT item_id, {WORDS.format("text")} AS w FROM eval_items),
            seed AS (
              SELECT item_id, least(13, len(w)) AS s, w[i:i + least(13, len(w)) - 1] AS run
              FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
            size AS (SELECT DISTINCT s FROM seed),
            doc AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
            runs AS (SELECT DISTINCT doc_id, s, w[i:i + s - 1] AS run FROM doc, size, unnest(range(1, len(w) - s + 2)) AS t(i))
            SELECT DISTINCT doc_id, item_id FROM runs JOIN seed USING (s, run)""",
        "p10_found": f"""
            WITH doc AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
            runs AS (SELECT doc_id, w[i:i + 7] AS run FROM doc, unnest(range(1, len(w) - 6)) AS t(i))
            SELECT doc_id FROM runs GROUP BY doc_id HAVING (count(*) - count(DISTINCT run)) / count(*) >= 0.3""",
        "p10_measure": rf"""
            WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            runs AS (SELECT doc_id, w[i:i + 7] AS run FROM (SELECT doc_id, {WORDS.format("t")} AS w FROM doc), unnest(range(1, len(w) - 6)) AS u(i)),
            r AS (SELECT doc_id, (count(*) - count(DISTINCT run)) / count(*) AS share FROM runs GROUP BY 1),
            part AS (
              SELECT doc_id, kind, regexp_replace(regexp_replace(p, '^{WHITE}+', ''), '{WHITE}+$', '') AS p
              FROM (SELECT doc_id, 'line' AS kind, unnest(string_split(t, chr(10))) AS p FROM doc UNION ALL SELECT doc_id, 'paragraph', unnest(string_split(t, chr(10) || chr(10))) FROM doc)),
            counted AS (SELECT doc_id, kind, length(p) AS chars, count(*) AS n FROM part WHERE p <> '' GROUP BY doc_id, kind, p),
            s AS (SELECT doc_id, kind, (sum(chars * n) - sum(chars)) / sum(chars * n) AS share FROM counted GROUP BY 1, 2)
            SELECT doc.doc_id, round(coalesce(r.share, 0), 9) AS run_share, round(coalesce(l.share, 0), 9) AS line_share, round(coalesce(p.share, 0), 9) AS paragraph_share
            FROM doc LEFT JOIN r USING (doc_id) LEFT JOIN (SELECT * FROM s WHERE kind = 'line') l USING (doc_id) LEFT JOIN (SELECT * FROM s WHERE kind = 'paragraph') p USING (doc_id)""",
    }
