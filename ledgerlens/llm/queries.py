"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard_join, langid, lexical, line_dedup, lm_score, mixing, prefix_trie, quality, sentencepiece_scan, sharding, suffix_dedup, warc
from ledgerlens.llm.common import materialize, read, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))


def _case_mask() -> str:
    return " + ".join(f"CASE WHEN {rule.sql()} THEN {quality.bit(r)} ELSE 0 END" for r, rule in quality.RULES.items())


MEASURES_SQL = r"""
base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
wins AS (SELECT rid, i, w[i:i+4] AS g FROM
    (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
spans AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM hits),
rep AS (SELECT rid, sum(n) AS n FROM spans GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter
  FROM words LEFT JOIN rep USING (rid))"""

ORACLE["op1_quality_rules"] = f"""WITH {MEASURES_SQL},
led AS (SELECT *, CAST({_case_mask()} AS BIGINT) AS fail_mask FROM m)
SELECT *, (fail_mask & {quality.policy_mask('base')}) <> 0 AS base_failed,
    (fail_mask & {quality.policy_mask('base') | quality.policy_mask(quality.CURRENT)}) = 0 AS kept,
    '{quality.CURRENT}' AS policy FROM led"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_common_lines(read(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


LINES_SQL = r"""
li AS (SELECT rid, i, x, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, unnest(l) AS x, generate_subscripts(l, 1) AS i
        FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS l FROM src))),
freq AS (SELECT k FROM li WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
out AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE freq.k IS NOT NULL) AS n_dropped,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE freq.k IS NULL), '') AS kept
  FROM li LEFT JOIN freq USING (k) GROUP BY rid)"""

ORACLE["op10_line_dedup"] = f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM out JOIN src USING (rid)"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    page = lambda c: F.col(c).try_cast("long")  # noqa: E731  a null id was written as "null"
    return warc.read_archives(spark, path).filter("kind = 'record'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))


ORACLE["op4_warc"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, CAST(unhex(sha1(b)) AS BIT)::VARCHAR AS s,
    max(page_id) OVER (PARTITION BY sha1(b)) AS m FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + list_sum(list_transform(range(0, 5), lambda j: (ascii(substr(s, 5 * i + j + 1, 1)) - 48) * (16 >> CAST(j AS INT)))) AS BIGINT), 1)), '')
        AS payload_digest,
    CASE WHEN m IS NULL OR m IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to FROM g"""


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), n_shards=24)
    digest = placed.select("row.doc_id", "size", F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
                           .alias("text_crc32"), "shard", "bin", "rank")
    slots = sharding.number_slots(materialize(digest, "shards"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("c0").alias("doc_id"), (F.col("n_items") > 0).alias("contaminated"),
                        "item_id", "similarity", "n_items")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similarity_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE["op7_ngram_jaccard_join"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * o >= 85 * (na + nb - o)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = s.doc_id) AS component_id FROM s"""


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(docs))
    return back.select(F.col("c0").alias("doc_id"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("c1")).alias("round_trip"))


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE["op11_mixing"] = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, source_size::DOUBLE / weight AS ratio FROM s),
lv AS (SELECT ratio, weight, source_size, (budget - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lev AS (SELECT arg_min(level, ratio) AS level FROM lv WHERE level * weight <= 2 * source_size),
t AS (SELECT f.source, source_size, CASE WHEN level IS NULL OR level * weight > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target
  FROM f, lev),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, rid) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)) AS BIGINT) AS taken FROM p"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op12_lexical_search"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS nd, sum(len(t))::BIGINT AS nt FROM d),
tf AS (SELECT rid, doc_id, n, g, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(t)::BIGINT AS n, unnest(t) AS g FROM d) GROUP BY ALL),
w AS (SELECT g, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY g, nd),
q AS (SELECT qid, item_id, unnest(list_distinct(t)) AS g FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS t FROM benchmark)),
s AS (SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // nt)))))::BIGINT AS score
  FROM q JOIN tf USING (g) JOIN w USING (g), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))))"""

ORACLE["op13_prefix_trie"] = f"""WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, CAST({_CRC32} % 6 AS BIGINT) AS h FROM t),
s AS (SELECT h.c, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS s FROM h LEFT JOIN t b ON b.c = h.c - h.c % 100),
m AS (SELECT c, d, s[1:d] AS p, s[1:d - 1] AS q, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS k, d = len(s) AS e
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT p, any_value(CASE WHEN d > 0 THEN q END) AS q, min(c) AS conv_id, d AS depth, count(*) AS n, any_value(k) AS k,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE e) AS ends FROM m GROUP BY p, d),
i AS (SELECT *, row_number() OVER () AS id FROM n),
kids AS (SELECT q AS p, count(*) AS n_children FROM n WHERE q IS NOT NULL GROUP BY q),
x AS (SELECT i.*, parent.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM i LEFT JOIN i parent ON parent.p = i.q LEFT JOIN kids ON kids.p = i.p),
g AS (SELECT m.c, x.id, x.depth, x.n, x.k, x.n_children FROM m JOIN x ON x.p = m.p),
sub AS (SELECT DISTINCT a.id AS top, b.id, b.n, b.k, b.n_children FROM g a JOIN g b ON a.c = b.c AND b.depth >= a.depth),
tot AS (SELECT top, sum((n - 1) * k) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM sub GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n AS n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256 FROM x JOIN tot ON tot.top = x.id"""
