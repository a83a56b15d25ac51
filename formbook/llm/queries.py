"""One query per operator, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm import decontaminate, langid, merkle, minhash, mixing, negatives, quality, secrets, suffix, topk, toxicity, urls, warc
from formbook.llm.common import held_out, remainder, table
from formbook.session import tune
from formbook.sources.tables import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.3


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(tune(spark), folder)
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"), ~held_out("doc_id", 4, 2))
    scored = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), toxicity.toxicity_score(lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learn(docs, ~held_out("doc_id", 5, 0))
    told = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), langid.language(model).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


URLS_SQL = r"""
WITH RECURSIVE
found AS (
  SELECT url, unnest(list_concat(regexp_extract_all(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'),
                                 regexp_extract_all(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'))) AS tag
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
aimed AS (
  SELECT url, coalesce(nullif(regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1), ''),
                       nullif(regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1), '')) AS t
  FROM found),
linked AS (
  SELECT DISTINCT url, CASE WHEN strpos(t, '://') > 0 THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t END AS target
  FROM aimed WHERE t IS NOT NULL),
addresses AS (SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT target FROM linked)),
parsed AS (
  SELECT u, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), ''), '/') AS tail, rest
  FROM (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) END AS rest FROM addresses)),
ruled AS (
  SELECT u, host, path, CASE WHEN rest IS NOT NULL THEN host || tail END AS node,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed),
judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled),
edges AS (
  SELECT a.node AS a, b.node AS b FROM linked l JOIN judged a ON l.url = a.u JOIN judged b ON l.target = b.u WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
classes AS (
  SELECT r.a AS node, CASE WHEN max((j.said = 'allow')::INT) = 1 THEN 'allow' WHEN max((j.said = 'block')::INT) = 1 THEN 'block' ELSE 'allow' END AS by_class
  FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) r JOIN judged j ON j.node = r.b GROUP BY r.a)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule AS rule, coalesce(j.said, c.by_class, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON p.url = j.u LEFT JOIN classes c ON j.node = c.node
"""


@query("op3_url_rules", URLS_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages")).drop("url")


@query("op4_minhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix.deduplicated(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"), ~held_out("doc_id", 5, 0))
    known = quality.with_statistics(docs.select("doc_id", "text"))
    scored = known.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that stands in it."""
    found = decontaminate.with_hits(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.start", "h.end")


@query("op8_secrets")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, secrets.discoveries(docs))
    # kinds are compared outside the lambda: its second parameter would be the place in the array
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = {f"n_{kind}": (F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long") for k, kind in enumerate(secrets.KINDS[:3])}
    every = secrets.written(F.concat("spans", "spans_random"))
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(secrets.written(F.col("spans")), 256).alias("base_sha256"), every.alias("spans"))


TOP_K_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_top_k", TOP_K_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(source, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, source_size * 3::DOUBLE AS most FROM s),
f AS (
  SELECT *, row_number() OVER o AS n,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
g AS (SELECT *, min(CASE WHEN most > weight * level THEN n END) OVER () AS first FROM f),
t AS (SELECT source, source_size, CASE WHEN n >= first THEN weight * (SELECT level FROM g WHERE n = first) ELSE most END AS target FROM g),
p AS (
  SELECT d.doc_id, d.source, d.size, d.place, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, k, (source_size * k + upto)::DOUBLE / target AS v FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY v, source IS NULL, coalesce(source, ''), place, k ROWS UNBOUNDED PRECEDING) AS run FROM e),
x AS (SELECT doc_id, place, sum(size)::BIGINT AS taken FROM c WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id, place)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(x.taken, 0)::BIGINT AS taken FROM p LEFT JOIN x ON p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.place = x.place
"""


@query("op10_mixing", MIX_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source")


def tree_sql(name: str, source: str, levels: int) -> str:
    """CTEs ``name``0 to ``name``levels (g, i, c, d: a tree, a place in a level, nodes of the level, a digest) and the steps of their nodes."""
    parts = [f"{name}0 AS (SELECT g, i, c, d FROM {source})"]
    for k in range(levels):
        run = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        parts.append(
            f"{name}s{k} AS (SELECT g, i, c, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})"
        )
        parts.append(
            f"{name}{k + 1} AS (SELECT g, i // 8 AS i, (max(c) + 7) // 8 AS c, CASE WHEN max(c) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k} GROUP BY g, i // 8)"
        )
    return ",\n".join(parts)


def fold_sql(name: str, source: str, levels: int) -> str:
    """CTEs that carry rows of ``source`` (g, i, p: proof, f: digest) up the tree ``name``."""
    parts, last = [], source
    for k in range(levels):
        parts.append(
            f"{name}f{k} AS (SELECT x.* EXCLUDE (p, f), x.p || s.b || s.a AS p, CASE WHEN s.c > 1 THEN sha256(s.b || x.f || s.a) ELSE x.f END AS f "
            f"FROM {last} x JOIN {name}s{k} s ON s.g = x.g AND s.i = x.i // {8**k})"
        )
        last = f"{name}f{k}"
    return ",\n".join(parts)


def leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS, _TOP = 7, 3
MERKLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
z AS (SELECT documents.*, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 3 = 0, false) AS hit FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf_sql("text")} AS d, CASE WHEN hit THEN {leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf_sql("text")} END AS f, '' AS p FROM z),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM leaves),
{tree_sql("n", "numbered", _LEVELS)},
tops AS (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c, d FROM n{_LEVELS}),
{tree_sql("u", "tops", _TOP)},
{fold_sql("n", "numbered", _LEVELS)},
joined AS (SELECT x.doc_id, x.d, x.p, x.f, t.d AS subroot, '' AS g, t.i FROM nf{_LEVELS - 1} x JOIN tops t ON t.lang = x.g),
{fold_sql("u", "joined", _TOP)}
SELECT doc_id, x.d AS leaf, subroot, r.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM uf{_TOP - 1} x, u{_TOP} r
"""


@query("op11_merkle", MERKLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The proof of every row, checked for rows of which every third has been tampered with."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(remainder("doc_id", 3) == 0, F.unhex(merkle.digest_of([*fields, F.translate("text", _UPPER, _LOWER)])))
    out = merkle.manifest(docs, keep={"tampered": tampered})
    out = out.withColumn("folded_root", merkle.folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q
"""


@query("op12_warc", WARC_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back; what is said of a response is computed from its payload as read."""
    place = work_folder(spark, "warc")
    warc.write(warc.records(table(spark, folder, "pages")), place)
    back = warc.read(spark, place, ["record_type", "record_id", "refers_to", "payload_digest", "http_length", "payload"])
    back = back.where(F.col("record_type").isin("response", "revisit"))
    whole = F.col("payload").isNotNull()
    return back.select(
        warc.page_id("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", warc.page_id("refers_to").alias("refers_to"),
    )


NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""


@query("op13_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)
