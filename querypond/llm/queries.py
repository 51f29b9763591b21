"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querypond.llm import boilerplate, chosen_path, knn, leakage, mixing, page_table, residue, segmenting, truncation
from querypond.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest_vectors(table(spark, d, "semantic_cache"), newest="hit_count"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "extractions")).select(F.col("id").alias("extraction_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.linked_pairs(*chosen_path.near_duplicates(table(spark, d, "search_results")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a result: its class of equal token sets and the number of results in other classes that it is linked to."""
    return chosen_path.link_counts(*chosen_path.all_groups(table(spark, d, "search_results")))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    extracted = page_table.common_form(table(spark, d, "extractions"), id_col="extraction_id", title="title", text="markdown", host="host", at="extracted_at", html=False)
    readable = page_table.common_form(table(spark, d, "readable_pages"), id_col="page_id", title="title", text="content_html", host="host", at="fetched_at", html=True)
    return extracted.unionByName(readable)


def _src() -> Column:
    return F.when(F.col("html"), "readable_pages").otherwise("extractions").alias("src")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    lines = page_table.parsed(_pages(spark, d))
    residual = residue.residue_pages(lines.where("NOT html")).select(F.lit(False).alias("html"), "id")
    return boilerplate.label_lines(lines).where("furniture").join(residual, ["html", "id"], "left_anti").select(_src(), F.col("id").alias("record_id"), "line_no")


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return boilerplate.main_bodies(pages, boilerplate.label_lines(page_table.parsed(pages))).select(_src(), "id", "body")


def _possibly_cut(spark: SparkSession, d: str) -> DataFrame:
    snippets = truncation.texts_of(table(spark, d, "search_results"), src="search_results", id_col="result_id", text="snippet", source="provider", at="ingested_at")
    articles = truncation.texts_of(table(spark, d, "gnews_articles"), src="gnews_articles", id_col="article_id", text="content_text", source="source_id", at="fetched_at")
    return snippets.unionByName(articles)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_possibly_cut(spark, d)).where("cut").select("src", F.col("id").alias("record_id"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(truncation.cut_texts(_possibly_cut(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return mixing.with_texts(mixing.mixture(documents, table(spark, d, "mix_targets"))[0], documents)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = segmenting.split_documents(table(spark, d, "documents"), with_text=False)
    return pieces.where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segmenting.split_documents(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"

_CUT = r"""WITH texts AS (SELECT 'search_results' AS src, result_id AS id, provider AS source, ingested_at AS seen, snippet AS body FROM search_results UNION ALL SELECT 'gnews_articles', article_id, source_id, fetched_at, content_text FROM gnews_articles),
s1 AS (SELECT src, id, source, seen, rtrim(regexp_replace(body, '[\s\x{00A0}]+', ' ', 'g')) AS body FROM texts WHERE length(trim(body)) > 0),
s2 AS (SELECT * REPLACE (regexp_replace(body, '&[a-zA-Z]{2,8};|&#[0-9]{1,6};', '"', 'g') AS body) FROM s1),
s3 AS (SELECT * REPLACE (rtrim(regexp_replace(body, '( ?(\.{2,}|…|\[(\.{3}|…)\]|\((\.{3}|…)\)|\[\+?[0-9]+ chars\]))+$', '')) AS body), regexp_matches(body, '(\x{FFFD}|\pL[-\x{2010}]|<[^<>]*|&#?[a-zA-Z0-9]*|[\(\[][^()\[\]]*)$') AS broken FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(regexp_replace(body, '`[^`]*`', ' ⓒ ', 'g'), 'https?://[^\s]+', ' ⓛ ', 'g') AS body) FROM s3),
s5 AS (SELECT *, regexp_replace(body, '(?s)^.*[.!?]["”»’)]*[ ]', '') AS tail FROM s4),
s6 AS (SELECT *, len(regexp_extract_all(tail, '[|·/,–&:(]')) AS marks, len(regexp_extract_all(tail, '[\pL\pN]+')) AS words FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN marks >= 3 AND words <= 2 * (marks + 1) THEN left(body, length(body) - length(tail)) || regexp_replace(tail, '[\pL\pN][\pL\pN.]*', 'ⓚ', 'g') ELSE body END AS body) FROM s6),
s8 AS (SELECT src, id, source, seen, broken, '^ ^ ' || trim(regexp_replace(regexp_replace(regexp_replace(body, '[0-9][0-9.,]*[0-9]|[0-9]', '0', 'g'), '[\pL\pM]+(?:[''’-]\pL+)*|[^\s]', ' \0 ', 'g'), '[ ]+', ' ', 'g')) AS tokens FROM s7),
shapes AS (SELECT src, id, source, seen, broken, string_split(lower(tokens), ' ') AS w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(tokens, '\p{Lu}[\pL\pM]*(?:[''’-]\pL+)*', 'A', 'g'), '\p{Ll}[\pL\pM]*(?:[''’-]\pL+)*', 'a', 'g'), '[\p{Lo}\p{Lm}\p{Lt}][\pL\pM]*', 'o', 'g'), '\s+', '', 'g') AS shape FROM s8),
every AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(shape) - 1), lambda i: substring(shape, i, 3))) AS t FROM shapes) GROUP BY t),
ends AS (SELECT right(shape, 3) AS t, count(*) AS f FROM shapes GROUP BY 1),
c AS (SELECT t, n, coalesce(f, 0) AS f FROM every LEFT JOIN ends USING (t)),
w AS (SELECT *, sum(f) OVER () / sum(n) OVER () AS chance, sum(n) OVER (PARTITION BY right(t, 2)) AS n2, sum(f) OVER (PARTITION BY right(t, 2)) AS f2, sum(n) OVER (PARTITION BY right(t, 1)) AS n1, sum(f) OVER (PARTITION BY right(t, 1)) AS f1 FROM c),
v AS (SELECT t, CASE WHEN n >= 30 THEN f < 2 * chance * n WHEN n2 >= 30 THEN f2 < 2 * chance * n2 ELSE f1 < 2 * chance * n1 END AS never FROM w WHERE f > 0),
wn AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS t FROM shapes) GROUP BY t),
wf AS (SELECT array_to_string(w[-3:], ' ') AS t, count(*) AS f FROM shapes GROUP BY 1), tot AS (SELECT sum(n) AS total, sum(f) / sum(n) AS chance FROM c),
wv AS (SELECT t FROM wn JOIN wf USING (t), tot WHERE n >= greatest(30, ceil(2e-5 * total)) AND f < 2 * chance * n),
flags AS (SELECT src, id, arg_max(source, seen) AS source, arg_max(broken OR wv.t IS NOT NULL OR coalesce(never, true), seen) AS cut FROM shapes LEFT JOIN v ON right(shape, 3) = v.t LEFT JOIN wv ON array_to_string(w[-3:], ' ') = wv.t GROUP BY src, id)"""

SQL = {
    "p3_found": f"""WITH r AS (SELECT result_id, title, snippet FROM search_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
s AS (SELECT result_id AS id, list_distinct({TOKENS.format(x="coalesce(title, '') || ' ' || coalesce(snippet, '')")}) AS w FROM r), k AS (SELECT id, w, len(w) AS n FROM s WHERE len(w) >= 16), tok AS (SELECT id, n, unnest(w) AS t FROM k), df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
p AS (SELECT id, t FROM tok JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, t) <= n - ceil(0.7 * n - 1e-9) + 1), c AS (SELECT DISTINCT a.id AS i, b.id AS j FROM p a JOIN p b ON a.t = b.t AND a.id < b.id),
m AS (SELECT i, j, len(list_intersect(a.w, b.w)) AS o, a.n AS x, b.n AS y FROM c JOIN k a ON a.id = i JOIN k b ON b.id = j) SELECT i AS result_a, j AS result_b FROM m WHERE o >= 0.7 * (x + y - o) - 1e-9""",
    "p3_groups": f"""WITH r AS (SELECT result_id, title, snippet FROM search_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
s AS (SELECT result_id AS id, list_sort(list_distinct({TOKENS.format(x="coalesce(title, '') || ' ' || coalesce(snippet, '')")})) AS w FROM r), k AS (SELECT id, w, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE '- ' || id END AS class FROM s),
c AS (SELECT class, any_value(w) AS w, len(any_value(w)) AS n, count(*) AS class_size, min(id) AS lowest FROM k GROUP BY class), tok AS (SELECT class, n, unnest(w) AS t FROM c), df AS (SELECT t, count(*) AS d FROM tok GROUP BY t),
p AS (SELECT class, n, t FROM tok JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY class ORDER BY d, t) <= n - ceil(0.7 * n - 1e-9) + 1), x AS (SELECT DISTINCT a.class AS i, b.class AS j FROM p a JOIN p b ON a.t = b.t AND a.class <> b.class AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
m AS (SELECT i, j, len(list_intersect(a.w, b.w)) AS o, a.n AS u, b.n AS v, b.class_size AS others FROM x JOIN c a ON a.class = i JOIN c b ON b.class = j), g AS (SELECT i AS class, sum(others)::BIGINT AS links FROM m WHERE o >= 0.7 * (u + v - o) - 1e-9 GROUP BY i)
SELECT id, lowest AS class, class_size, coalesce(links, 0) AS links FROM k JOIN c USING (class) LEFT JOIN g USING (class)""",
    "p6_found": _CUT + " SELECT src, id AS record_id FROM flags WHERE cut",
    "p6_shares": _CUT + " SELECT src, source, count(*) AS texts, count_if(cut)::BIGINT AS cut_texts, round(count_if(cut) / count(*), 6) AS share FROM flags GROUP BY src, source",
    "p1_found": """WITH one AS (SELECT entry_id, embedding FROM semantic_cache WHERE len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY hit_count DESC) = 1),
v AS (SELECT entry_id, embedding::DOUBLE[] AS e FROM one WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.entry_id AS i, b.entry_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.entry_id < b.entry_id),
n AS (SELECT i, j, c FROM s WHERE c >= 0.92 UNION ALL SELECT j, i, c FROM s WHERE c >= 0.92)
SELECT DISTINCT least(i, j) AS entry_a, greatest(i, j) AS entry_b FROM (SELECT i, j FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) <= 5)""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {TOKENS.format(x='text')} AS w FROM documents), i AS (SELECT item_id, {TOKENS.format(x='item_text')} AS w FROM eval_items), i2 AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS run FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i2)),
sizes AS (SELECT DISTINCT n FROM iw), dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, sizes WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, run)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
