"""One query for each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenlight.llm import alignment, decontaminate, jaccard_join, language_id, line_dedup, lm, packing, periodic, personal, personal_labels, quality, topk_search, url_filter, warc
from greenlight.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from greenlight.session import shared_dir


def fold(parts: int):
    """The fold of a document: the CRC-32 of its id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    model = language_id.learn(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    ensemble = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, ensemble)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


SQL["op4_topk_search"] = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from whole q join whole c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored) where rank <= 10
"""


#: Host, path and verdict of the production rules (fixed values).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, default="allow")


SQL["op2_url_filter"] = """
with rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select s.page_id, s.host, s.path, r.host || r.path as rule, r.verdict
  from split s left join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select page_id, host, path, max_by(rule, length(rule)) as rule, coalesce(max_by(verdict, length(rule)), 'allow') as verdict
from fits group by page_id, host, path
"""


@query
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, min_words=3, similarity=0.8).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op6_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(7) == 2, F.lit(False))
    model, words = lm.learn(docs.where(~held_out))
    scored = lm.score(docs, model, words)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op8_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "matched")


@query
def op10_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"), shared_dir(spark), min_revisit_bytes=0)
    checked = F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.lit("a record does not hold against its digests")))
    return records.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


SQL["op10_warc"] = """
with pages_ as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
first_ as (select hex, min(page_id) as first_id from pages_ group by hex)
select p.page_id, strlen(p.payload)::bigint as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(p.hex, (5 * (k // 4) + 1)::int, 5))::bigint >> (5 * (3 - k % 4))::int) % 32)::int + 1, 1)), lambda a, b: a || b) as payload_digest,
  case when p.page_id = f.first_id then 'response' else 'revisit' end as record_type,
  case when p.page_id = f.first_id then null else f.first_id end as refers_to
from pages_ p join first_ f using (hex)
"""


@query
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), *paths)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_planted_period(docs):
    """Every tenth document, by the CRC-32 of its id, with its words from some place on made periodic (fixed rule of the query)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic.collapse(with_planted_period(table(spark, sf_dir, "documents")), least=24)

    def better(best, run):
        """Greater length / period, told in whole numbers; runs come by start and period, so the first of equals stays."""
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = found.withColumn("best", F.aggregate("runs", none, better))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_personal_data(spark, sf_dir):
    field = personal.learn(spark.createDataFrame(personal_labels.labelled(), personal_labels.SCHEMA))
    found = personal.find(table(spark, sf_dir, "documents"), field)
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n_of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n_of, personal.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))
