"""One registered query for each operator: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import bpe, collocations, contexts, divergence, near_copies, neighbours, packing, piecewise, secrets, sharding, toxicity, tries, warc

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_bpe(spark, sf):
    coded = bpe.encode_decode(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_sharding(spark, sf):
    placed = sharding.shard_rows(table(spark, sf, "documents"), shards=16)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query
def op9_warc(spark, sf):
    manifest = warc.write_archives(table(spark, sf, "pages"), warc.archive_folder(spark), least=0)
    return warc.read_archives(manifest, "bigint", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 from the hex digest: five bits lie in the two hex digits from number 5i / 4 on.
ORACLE["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
    SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h || '0', 1 + (5 * i // 4)::INTEGER, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g"""


@query
def op4_piecewise(spark, sf):
    return piecewise.fingerprints(table(spark, sf, "documents"))


@query
def op7_secrets(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    base = "filter(findings, f -> f.depth = 0)"
    joined = "array_join(transform({}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(findings, f -> f.depth = 0 and f.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("findings")).alias("spans"),
        F.expr("cast(size(filter(findings, f -> f.depth > 0)) as long)").alias("n_hidden"), "layers", "oversized",
    )


@query
def op1_neighbours(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = neighbours.fit(docs, neighbours.learnable(table(spark, sf, "labels")))
    scored = neighbours.score(docs, model).drop("text")
    return scored.select(
        "doc_id", neighbours.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= neighbours.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op3_divergence(spark, sf):
    return divergence.rules(table(spark, sf, "documents"))


@query
def op6_near_copies(spark, sf):
    return near_copies.near_classes(table(spark, sf, "documents"))


@query
def op5_contexts(spark, sf):
    found = contexts.find(table(spark, sf, "documents"))
    joined = "array_join(transform({}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"
    base = "filter(findings, f -> f.base)"
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(findings, f -> f.base and f.kind = '{k}')) as long)").alias(f"n_{k}") for k in contexts.KINDS),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("findings")).alias("spans"),
        F.expr("cast(size(filter(findings, f -> not f.base)) as long)").alias("n_discovered"),
    )


@query
def op11_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


ORACLE["op11_collocations"] = r"""WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
    n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
    i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, ws[i : i + k - 1] AS g, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 100),
    inner_ AS (SELECT DISTINCT f.lang, f.g[s : s + m - 1] AS g, f.a FROM f, (SELECT unnest([1, 2, 3, 4]) AS s), (SELECT unnest([2, 3, 4]) AS m) WHERE m < f.k AND s + m - 1 <= f.k),
    c AS (SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM inner_ o WHERE o.lang = f.lang AND o.g = f.g AND 100 * o.a >= 100 * f.a)),
    cut AS (SELECT c.*, x, f1.a AS l, f2.a AS r, n, (1000::HUGEINT * c.a * n) // (f1.a::HUGEINT * f2.a) AS score
        FROM c, (SELECT unnest([1, 2, 3, 4]) AS x), n, f f1, f f2
        WHERE x < c.k AND n.lang = c.lang AND f1.lang = c.lang AND f2.lang = c.lang AND f1.g = c.g[: x] AND f2.g = c.g[x + 1 :]),
    best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, x) = 1),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""


@query
def op12_prefix_trie(spark, sf):
    return tries.prefix_trie(table(spark, sf, "conversations"))


#: crc32 bit by bit; leaves and savings by way of the conversation with the least id, whose path holds all nodes above.
ORACLE["op12_prefix_trie"] = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p, d, size FROM
        (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS d, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
    cs AS (SELECT DISTINCT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM t),
    r AS (SELECT cs.c, t.p, t.d, t.size FROM cs JOIN t ON t.c = cs.c - cs.c % 100 AND t.p <= cs.h UNION ALL SELECT cs.c, t.p, t.d, t.size FROM cs JOIN t ON t.c = cs.c AND t.p > cs.h),
    m AS (SELECT c, row_number() OVER w AS depth, string_agg(d, '') OVER w AS key, size FROM r WINDOW w AS (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT c, 0, '', 0 FROM cs),
    last AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
    nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n, any_value(size) AS size FROM m GROUP BY key, depth),
    up AS (SELECT key, depth, conv_id, n, size, left(key, len(key) - 32) AS above FROM nodes),
    kids AS (SELECT above, depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
    own AS (SELECT u.*, coalesce(k.n, 0) AS children FROM up u LEFT JOIN kids k ON k.above = u.key AND k.depth = u.depth + 1),
    sub AS (SELECT m.key, m.depth, count(*) FILTER (WHERE o.children = 0) AS leaves, sum((o.n - 1) * o.size) AS saved FROM own o JOIN m ON m.c = o.conv_id AND m.depth <= o.depth GROUP BY ALL),
    ended AS (SELECT m.key, m.depth, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS sha FROM m JOIN last l ON l.c = m.c AND l.depth = m.depth GROUP BY ALL)
    SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
        coalesce(e.sha, sha256('')) AS ends_sha256
    FROM own o LEFT JOIN own p ON o.depth > 0 AND p.key = o.above AND p.depth = o.depth - 1 JOIN sub s ON s.key = o.key AND s.depth = o.depth LEFT JOIN ended e ON e.key = o.key AND e.depth = o.depth"""


@query
def op13_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )
