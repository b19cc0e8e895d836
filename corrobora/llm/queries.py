"""Queries of the operators over the supplied tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import chat, convrepair, decontam, epsgrid, filteraudit, langid, lm, neardup, packing, secretscan, tokenbin, topk, toxicity
from corrobora.llm._shared import remainder, table

#: The end-of-document id that op10 appends.
END_ID = 2


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS x(conv_id, turn, role, text)", args={"t": own})
    return chat.digest(chat.render_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held)
    return docs.select("doc_id", held.alias("held_out"), langid.language_of(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return docs.select("doc_id", held.alias("held_out"), toxicity.toxicity_of(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), secretscan.default_forest(spark))
    return out.select("doc_id", "secrets.n_candidates", "secrets.n_secrets", "secrets.max_score", F.sha2(F.array_join("secrets.found", "\n"), 256).alias("found_sha256"), F.sha2(F.coalesce("secrets.redacted", F.lit("")), 256).alias("redacted_sha256"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), into="c").select("doc_id", "c.*")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_documents(tokenbin.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_digest(convrepair.damage(table(spark, sf_dir, "conversations")))


def op12_epsgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsgrid.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_chat, op3_minhash, op4_langid, op5_toxicity, op6_packing, op7_secrets, op8_lm, op9_decontam, op10_tokens, op11_repair, op12_epsgrid, op13_filter_audit)}

ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_chat": r"""
        WITH t AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), m AS (
            SELECT *, regexp_matches(text, '</?s>|\[INST|\[/INST\]|\[OUT|\[/?SYS|\[/?ROLE|\[/TURN\]') AS clash, length(regexp_replace(text, '[^&<\[]', '', 'g')) AS marks,
                CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 14 WHEN 'system' THEN 16 ELSE NULL END AS frame
            FROM t
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
            CAST(sum(frame + length(text) + CASE WHEN clash THEN 1 + 2 * marks ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op9_decontam": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bs AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bs),
        sizes AS (SELECT DISTINCT n FROM win),
        ds AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        occ AS (
            SELECT x.doc_id, x.i, x.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM ds, sizes WHERE i + n - 1 <= len(w)) x JOIN win ON win.s = x.s AND win.n = x.n
        ),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_repair": r"""
        WITH RECURSIVE bits AS (
            SELECT i, i AS v, 0 AS k FROM range(256) AS t(i)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
        named AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), hit AS (
            SELECT n.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda a, c: xor(tab[(xor(a, c) & 255) + 1], a >> 8)), CAST(4294967295 AS BIGINT)) % 20 AS h
            FROM named AS n, crc
        ), dam AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hit WHERE h <> 0
        ), pos AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i,
                NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, substr(role, 1, 1) AS k
            FROM dam
        ), dup AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(k) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM pos),
        r AS MATERIALIZED (
            SELECT conv_id, turn, i, role, text, k, blank, again, NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') AS cut, blank OR again AS must,
                was IS NOT NULL AND was || k NOT IN ('su', 'ua', 'au') AS bad, CASE WHEN NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS x
            FROM dup
        ), sums AS (
            SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate, count_if(cut) AS truncated, count_if(bad) AS illegal
            FROM r GROUP BY conv_id
        ), back AS (  -- from row i + 1 on: the least cost from each state of the grammar, turns may be inserted first
            SELECT conv_id, n AS i, CAST(0 AS BIGINT) AS b0, CAST(10 AS BIGINT) AS b1, CAST(5 AS BIGINT) AS b2, CAST(0 AS BIGINT) AS b3 FROM sums
            UNION ALL
            SELECT conv_id, i, least(c0, 5 + c2, 10 + c3), least(c1, 5 + c2, 10 + c3), least(c2, 5 + c3), least(c3, 5 + c2) FROM (
                SELECT r.conv_id, r.i - 1 AS i,
                    least(2 + b0, CASE WHEN must THEN 1e12 ELSE x + least(1 + b2, CASE k WHEN 's' THEN b1 WHEN 'u' THEN b2 ELSE 1e12 END) END) AS c0,
                    least(2 + b1, CASE WHEN must THEN 1e12 ELSE x + least(1 + b2, CASE k WHEN 'u' THEN b2 ELSE 1e12 END) END) AS c1,
                    least(2 + b2, CASE WHEN must THEN 1e12 ELSE x + least(1 + b3, CASE k WHEN 'a' THEN b3 ELSE 1e12 END) END) AS c2,
                    least(2 + b3, CASE WHEN must THEN 1e12 ELSE x + least(1 + b2, CASE k WHEN 'u' THEN b2 ELSE 1e12 END) END) AS c3
                FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i
            )
        ), cost AS MATERIALIZED (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM back),
        walk AS (  -- s: the state; e: the edit that led here
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines, n FROM sums
            UNION ALL
            SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE k WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE g END, audit || e,
                CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE g WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END, n
            FROM (
                SELECT *, CASE WHEN i < n AND nxt[s + 1] + 2 = now[s + 1] THEN 'D' WHEN now[g + 1] + 5 = now[s + 1] THEN 'I'
                    WHEN NOT must AND (k = 'u' AND s <> 2 AND nxt[3] + x = now[s + 1] OR k = 'a' AND s = 2 AND nxt[4] + x = now[s + 1] OR k = 's' AND s = 0 AND nxt[2] + x = now[s + 1]) THEN 'K' ELSE 'R' END AS e
                FROM (
                    SELECT w.*, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS g, c.b AS now, d.b AS nxt, r.k, r.role, r.text, r.must, r.x
                    FROM walk AS w JOIN cost AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i
                    LEFT JOIN cost AS d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1
                    LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
                    WHERE w.i < w.n OR w.s IN (1, 2)
                )
            )
        ), done AS (SELECT * FROM walk WHERE i = n AND s IN (0, 3)),
        ids AS (SELECT DISTINCT conv_id FROM named)
        SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
            CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost.b[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN cost ON cost.conv_id IS NOT DISTINCT FROM ids.conv_id AND cost.i = 0""",
    "op12_epsgrid": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS n, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e,
                embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
            FROM embeddings
        ), s AS MATERIALIZED (SELECT n, vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE sound),
        links AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM s AS a JOIN s AS b ON a.n <> b.n AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.9 * a.size * b.size),
        reach AS (SELECT n AS a, n AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        low AS (SELECT reach.a AS n, min(s.vec_id) AS component_id FROM reach JOIN s ON s.n = reach.b GROUP BY reach.a),
        many AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), true) AS kept
        FROM v LEFT JOIN low USING (n) LEFT JOIN many USING (n)""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
        one AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN one USING (doc_id)
        ), cells AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l AS a JOIN l AS b ON b.x <> a.x JOIN l AS c ON c.x NOT IN (a.x, b.x) JOIN l AS d ON d.x NOT IN (a.x, b.x, c.x) JOIN l AS e ON e.x NOT IN (a.x, b.x, c.x, d.x)
        ), steps AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS t(step)),
        told AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, n, good, bad, fails, contains(fails, filter) AS here, before <> '' AND translate(fails, before, '') <> fails AS earlier FROM cells, steps
        ), summed AS (
            SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant,
                coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails, coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT earlier AND bad), 0) AS toxic_lost
            FROM told GROUP BY ALL
        )
        SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
        FROM summed""",
}
