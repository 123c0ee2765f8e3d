"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import benchmark_leaks, covering_simhash, language_id, license_rules, neighbour_routes, pareto_mix, prefix_trie, quality_mcd, repeats, sharding, url_rules, variable_packing, vector_codes
from wattloom.llm.common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(table(spark, folder, "documents"), 40)  # whole documents; the digests are of what arrived
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = covering_simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = pareto_mix.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_mixing"] = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::DOUBLE AS s FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
lined AS (SELECT *, row_number() OVER (ORDER BY s / w, place) AS line FROM weighed),
filled AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * (sum(s) OVER (ORDER BY line) - s)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY line) - w)) AS level FROM lined),
flagged AS (SELECT *, level * w > 2.0::DOUBLE * s AS capped FROM filled),
aims AS (SELECT source, s, capped OR s = 0 AS capped, CASE WHEN capped OR s = 0 THEN 2.0::DOUBLE * s
    ELSE w * (SELECT arg_min(level, line) FROM flagged WHERE NOT capped) END AS target FROM flagged),
classed AS (SELECT *, length(bin(size)) AS class FROM docs),
sums AS (SELECT source, class, sum(size)::DOUBLE AS words, class::DOUBLE AS q FROM classed WHERE size > 0 GROUP BY source, class),
leveled AS (SELECT a.source, class, q, words, s, target, capped,
    (target - 2.0::DOUBLE * (sum(words) OVER up - words)) / (sum(words * q) OVER (PARTITION BY a.source) - (sum(words * q) OVER up - words * q)) AS level
    FROM sums JOIN aims a ON sums.source IS NOT DISTINCT FROM a.source WINDOW up AS (PARTITION BY a.source ORDER BY class DESC)),
topped AS (SELECT *, capped OR level * q > 2.0::DOUBLE AS top FROM leveled),
picked AS (SELECT source, arg_max(level, class) AS level FROM topped WHERE NOT top GROUP BY source),
meant AS (SELECT t.*, CASE WHEN top THEN 2.0::DOUBLE ELSE q * p.level END AS copies FROM topped t LEFT JOIN picked p ON t.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS part, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest FROM meant),
drawn AS (SELECT c.*, whole, part, rest, (('0x' || substr(md5('4:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM classed c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class WHERE size > 0),
ranked AS (SELECT *, u * (1 - part) / ((1 - u) * part) AS rank FROM drawn WHERE part > 0),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS upto FROM ranked),
more AS (SELECT DISTINCT source, doc_id, size FROM summed WHERE upto - size / 2.0::DOUBLE <= rest)
SELECT d.doc_id, d.size, a.s::BIGINT AS source_size, a.target,
    (CASE WHEN d.size = 0 THEN 0 ELSE d.size * (p.whole + CASE WHEN m.doc_id IS NULL THEN 0 ELSE 1 END) END)::BIGINT AS taken
FROM classed d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
LEFT JOIN parts p ON d.source IS NOT DISTINCT FROM p.source AND d.class = p.class
LEFT JOIN more m ON d.doc_id = m.doc_id AND d.source IS NOT DISTINCT FROM m.source AND d.size = m.size
"""


@_query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return variable_packing.pack_texts(table(spark, folder, "documents"))


@_query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    found = language_id.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.scan_licenses(table(spark, folder, "documents")).drop("spans")


@_query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_mcd.judge(table(spark, folder, "documents"))
    return found.select("doc_id", *quality_mcd.COUNTS, "base_failed", "kept")


@_query
def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.expr("quality = 0 OR toxic = 1").alias("rejected"))
    return url_rules.judge(table(spark, folder, "pages"), labels)


@_query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_routes.search(table(spark, folder, "embeddings"), "id % 50 = 0", k=5)


@_query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_leaks.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    listed = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


ORACLES["op11_decontamination"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
begun AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS b FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[b:b + 9], ' ') AS t FROM begun),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS b FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT r, b, p.n, item_id FROM (SELECT r, b, n, array_to_string(w[b:b + n - 1], ' ') AS t FROM places) p JOIN windows x ON p.n = x.n AND p.t = x.t),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(b, b + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit ON docs.r = hit.r LEFT JOIN named ON docs.r = named.r
"""


@_query
def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = written(prefix_trie.pack_turns(table(spark, folder, "conversations")))
    head = F.crc32(F.col("conv_id").cast("string")) % 9 * prefix_trie.TURN
    lent = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.substring("path", 1, 8 * prefix_trie.TURN).alias("lent"))
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(lent, "base", "left").withColumn("head", head.cast("int"))
    rebuilt = joined.selectExpr("conv_id", "concat(coalesce(substring(lent, 1, head), X''), substring(path, head + 1)) AS path")
    return prefix_trie.trie(rebuilt)


ORACLES["op12_trie"] = """
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, encode(c::VARCHAR) AS e FROM turns),
crc AS (SELECT c, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(e) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))) AS v FROM ids),
heads AS (SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc),
rebuilt AS (SELECT heads.c, k, role, text FROM heads JOIN turns ON turns.c = heads.base AND k <= h
    UNION ALL SELECT heads.c, k, role, text FROM heads JOIN turns ON turns.c = heads.c AND k > h),
paths AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS t, octet_length(encode(text)) AS bytes FROM rebuilt),
prefixes AS (SELECT c, d, bytes, string_agg(t, '/') OVER (PARTITION BY c ORDER BY d) AS p FROM paths
    UNION ALL SELECT c, 0, 0, '' FROM heads),
depths AS (SELECT c, max(d) AS last FROM prefixes GROUP BY c),
ends AS (SELECT p, sha256(string_agg(x.c::VARCHAR, ',' ORDER BY x.c)) AS sha FROM prefixes x JOIN depths y ON x.c = y.c AND d = last GROUP BY p),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, max(bytes) AS bytes FROM prefixes GROUP BY p, d),
pairs AS (SELECT p, CASE WHEN d <= 1 THEN '' ELSE left(p, length(p) - 65) END AS over, d, c FROM nodes),
kids AS (SELECT over, count(*) AS n FROM pairs WHERE d > 0 GROUP BY over),
below AS (SELECT a.p, sum((b.n - 1) * b.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
    FROM nodes a JOIN nodes b ON b.d >= a.d AND starts_with(b.p || '/', CASE WHEN a.d = 0 THEN '' ELSE a.p || '/' END) LEFT JOIN kids ON kids.over = b.p GROUP BY a.p)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, CASE WHEN x.d > 0 THEN o.c END AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
    below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM nodes x JOIN pairs USING (p) LEFT JOIN nodes o ON o.p = pairs.over LEFT JOIN kids ON kids.over = x.p JOIN below ON below.p = x.p LEFT JOIN ends ON ends.p = x.p
"""


@_query
def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    found = vector_codes.with_label_error(codes)
    return found.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_sha256()).alias("codebooks_sha256"))


def _codebooks_sql(rounds: int = 6) -> str:
    """Rounds written out one after the other."""
    assigned = """
near{r} AS MATERIALIZED (SELECT v, x.p, arg_min(struct_pack(j := j, d := d), d * 16 + j) AS best FROM (SELECT v, x.p, j, list_sum(list_transform(range(1, 9), lambda i: (x.c[i] - b.c[i]) ** 2))::BIGINT AS d
    FROM parts x JOIN book{r} b ON x.p = b.p) x GROUP BY v, x.p)"""
    moved = """,
book{n} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, j, list(floor(total / n)::BIGINT ORDER BY i) AS c
    FROM (SELECT a.p, best.j AS j, i, sum(c[i])::DOUBLE AS total, count(*) AS n FROM near{r} a JOIN parts x ON a.v = x.v AND a.p = x.p, range(1, 9) t(i) GROUP BY ALL) GROUP BY p, j) m ON b.p = m.p AND b.j = m.j)"""
    steps = ",".join(assigned.format(r=r) + (moved.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT v, p, w[8 * p + 1:8 * p + 8] AS c FROM kept, range(8) t(p)),
book0 AS MATERIALIZED (SELECT p, v AS j, c FROM parts WHERE v < 16),{steps},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS s FROM book{rounds}),
coded AS (SELECT v, string_agg(format('{{:02x}}', best.j), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY v)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (v), sha
"""


ORACLES["op13_codes"] = _codebooks_sql()
