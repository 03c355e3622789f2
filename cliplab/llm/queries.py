"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplab.llm import (
    decontamination,
    fingerprints,
    jaccard_join,
    language,
    main_text,
    mixing,
    neighbours,
    pieces,
    prefix_trie,
    pseudo_likelihood,
    repeated_windows,
    url_templates,
    vector_codes,
)
from cliplab.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query(
    "op5_jaccard_join",
    r"""WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: list_slice(ws, i, i + 2))) AS g
              FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id
                  GROUP BY 1, 2) x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)


@query(
    "op7_repeated_windows",
    r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: list_slice(ws, i, i + 19))) AS g
              FROM w WHERE len(ws) >= 20),
        late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
          sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
            list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.repeated_word_report(table(spark, sf_dir, "documents"), width=20)


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_copies(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, limit=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op9_nearest_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


_SEGMENTS = r"""list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
            lambda s: regexp_replace(s, '[0-9a-fA-F]{16,}|[0-9]+', '#', 'g'))"""


@query(
    "op6_url_templates",
    rf"""WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, {_SEGMENTS} AS parts, try_cast(nullif(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1), '') AS BIGINT) AS shown FROM u),
        m AS (SELECT r.*, parts AS segs,
            CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 WHEN l.doc_id IS NOT NULL THEN 0 END AS bad FROM r LEFT JOIN labels l ON l.doc_id = shown),
        c AS (SELECT host, segs, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad FROM m GROUP BY ALL),
        tp AS (SELECT host, segs, n, lab, bad, []::VARCHAR[] AS names FROM c UNION ALL
          SELECT host, segs, n, lab, bad, list_append(names, CASE WHEN kinds >= 8 AND kinds >= 0.3 * an THEN '*' WHEN kinds = 1 THEN seg
            WHEN sl > 0 AND al > sl AND ab > 0 AND ab < al AND abs(sb / sl - (ab - sb) / (al - sl)) > 1.96 * sqrt(ab / al * (1 - ab / al) * (1 / sl + 1 / (al - sl)))
            THEN seg ELSE '~' END)
          FROM (SELECT *, count(DISTINCT seg) OVER up AS kinds, sum(n) OVER up AS an, sum(lab) OVER up AS al, sum(bad) OVER up AS ab,
                  sum(lab) OVER own AS sl, sum(bad) OVER own AS sb FROM (SELECT *, segs[len(names) + 1] AS seg FROM tp WHERE len(names) < len(segs))
                WINDOW up AS (PARTITION BY host, names), own AS (PARTITION BY host, names, seg))),
        t AS (SELECT host, segs, lab, bad, CASE WHEN names = [] THEN '' ELSE '/' || array_to_string(names, '/') END AS template
              FROM tp WHERE len(names) = len(segs)),
        g AS (SELECT coalesce(1 - sum(bad) / nullif(sum(lab), 0), 1.0) AS p FROM c),
        h AS (SELECT host, (sum(lab) - sum(bad) + 4.0::DOUBLE * any_value(p)) / (sum(lab) + 4.0::DOUBLE) AS hp FROM c, g GROUP BY host),
        j AS (SELECT host, template, (sum(lab) - sum(bad) + 4.0::DOUBLE * any_value(hp)) / (sum(lab) + 4.0::DOUBLE) AS purity FROM t JOIN h USING (host) GROUP BY ALL),
        v AS (SELECT page_id, host, path, CASE
            WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule, template, purity
            FROM m JOIN t USING (host, segs) JOIN j USING (host, template))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity FROM v""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no labels themselves: the last number of a url's path names the document that the page shows."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    _, path = url_templates.url_parts(F.col("url"))
    shown = pages.select("page_id", F.regexp_extract(path, "/([0-9]+)[^/]*/?$", 1).try_cast("long").alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    return url_templates.judge_urls(pages, shown.join(bad, "doc_id"), rules, max_depth=None)


@query(
    "op10_main_text",
    r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '<[^>]*\z', '') AS body FROM pages),
        b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'),
            lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
              '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS bs FROM a)
        SELECT page_id, url, coalesce(array_to_string(bs, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(bs, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM b""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language.with_language(docs).withColumn("held_out", language.held_out(F.col("doc_id")))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query("op8_pseudo_likelihood")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.word_scores(table(spark, sf_dir, "documents"))


@query(
    "op11_positional_index",
    r"""WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        g AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT len(g) AS n FROM g),
        s AS (SELECT k, i, list_slice(ws, i, i + n - 1) AS g, n FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
        hit AS (SELECT k, i, n, s.g FROM s SEMI JOIN g ON s.g = g.g),
        words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
        named AS (SELECT k, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit JOIN g ON hit.g = g.g GROUP BY k)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
          sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN words USING (k) LEFT JOIN named USING (k)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    ids = F.col("item_ids")
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated"
    )


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64) -> str:
    """Two rounds and the last assignment, spelled out."""
    assign = """a{i} AS (SELECT k, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS m
            FROM pts JOIN b{i} USING (p) GROUP BY k, p)"""
    update = """u{i} AS (SELECT p, m.c AS c, [{means}] AS e FROM pts JOIN a{i} USING (k, p) GROUP BY p, m.c),
        b{j} AS (SELECT b{i}.p, b{i}.c, coalesce(u{i}.e, b{i}.e) AS e FROM b{i} LEFT JOIN u{i} USING (p, c))"""
    means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
    steps = [assign.format(i=0)]
    for i in range(2):
        steps += [update.format(i=i, j=i + 1, means=means), assign.format(i=i + 1)]
    chain = ",\n        ".join(steps)
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
              FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        pts AS (SELECT k, p, list_slice(x, {width} * p + 1, {width} * p + {width}) AS x FROM v, range({parts}) AS r(p)),
        b0 AS (SELECT p, k - 1 AS c, x AS e FROM pts WHERE k <= {entries}),
        {chain},
        books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) AS s FROM b2),
        codes AS (SELECT k, string_agg(lpad(lower(to_hex(m.c)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY k)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256
        FROM v JOIN codes USING (k), books"""


@query("op12_vector_codes", _codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


@query(
    "op13_prefix_trie",
    r"""WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT *, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, byte:
              list_reduce(range(8)::BIGINT[], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM t),
        r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS p
              FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
        m AS (SELECT conv_id, len(p) AS n, d AS depth, list_slice(p, 1, d) AS p FROM r, unnest(range(0, len(p) + 1)) AS u(d)),
        nodes AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (n = depth) AS e,
              string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM m GROUP BY depth, p),
        own AS (SELECT n.*, up.conv_id AS parent_conv_id, coalesce(c.k, 0) AS n_children, (n.n_convs - 1) * length(coalesce(n.p[-1].t, '')) AS saved
              FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.p = list_slice(n.p, 1, n.depth - 1)
              LEFT JOIN (SELECT depth - 1 AS depth, list_slice(p, 1, depth - 1) AS p, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY ALL) c
                ON c.depth = n.depth AND c.p = n.p),
        below AS (SELECT d AS depth, list_slice(p, 1, d) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
              FROM own, unnest(range(0, depth + 1)) AS u(d) GROUP BY ALL)
        SELECT conv_id, own.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM own JOIN below ON below.depth = own.depth AND below.p = own.p""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
