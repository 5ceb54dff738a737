"""The named queries of this folder, each over its whole table, with SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.llm import attention_lm, decontaminate, hard_negatives, language, line_dedup, mixing, ngram_join, periodic_runs, personal_data, sharding, spotsigs, token_counts, warc
from billmill.llm.common import split_of, table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}
TOKENIZERS = "/opt/tokenizers"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


@query("op1_line_dedup")
def _(spark, d):
    return line_dedup.deduplicated(table(spark, d, "documents"))


@query("op2_benchmark_decontamination")
def _(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), near=True)


# Base32 of a 40-bit piece of a digest, eight characters of five bits each.
_BASE32 = "".join(
    f"|| substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {10 * piece + 1}, 10))::BIGINT >> {5 * (7 - i)}) & 31)::INT, 1)"
    for piece in range(4)
    for i in range(8)
)


@query("op3_warc_index_merge", f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
      split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#', 1) AS rest FROM pages),
    k AS (SELECT page_id, strlen(html) AS payload_bytes, '' {_BASE32} AS payload_digest,
      coalesce(array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), ':[0-9]*$', '')),
        '.')), ',') || ')' || CASE WHEN rest = regexp_extract(rest, '^[^/?]*') THEN '/'
        ELSE substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) END, '') AS url_key FROM p),
    f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM k GROUP BY ALL)
    SELECT page_id, k.payload_bytes, k.payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to, url_key,
      row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
    FROM k JOIN f USING (payload_digest, payload_bytes)""")
def _(spark, d):
    # The table has no capture time; one page a second, in order of the ids, stands for it.
    captured = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id"))
    entries = warc.archive(table(spark, d, "pages").withColumn("captured", captured))
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


@query("op4_spotsigs_fingerprints")
def _(spark, d):
    return spotsigs.fingerprints(table(spark, d, "documents"))


@query("op5_ngram_jaccard_join")
def _(spark, d):
    return ngram_join.join(table(spark, d, "documents"))


@query("op6_shards_by_vector_packing")
def _(spark, d):
    placed = sharding.shard_documents(table(spark, d, "documents"), 16)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query("op7_language_id")
def _(spark, d):
    held_out = split_of(F.col("doc_id"), 4) == 2
    found = language.identify(table(spark, d, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_soft_membership_mixing")
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    rates = mixing.mix(table(spark, d, "documents"), labels, {"good": 0.9, "junk": 0.1, "toxic": 0.0})
    shares = [F.element_at("posterior", F.lit(name)).alias(f"p_{name}") for name in ("good", "junk", "toxic")]
    return rates.select("doc_id", "n_tokens", "domain", *shares, "rate")


@query("op9_token_counts")
def _(spark, d):
    pieces = token_counts.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, d, "documents"), pieces)


@query("op10_attention_lm")
def _(spark, d):
    held_out = split_of(F.col("doc_id"), 7) == 2
    found = attention_lm.score(table(spark, d, "documents"), ~held_out, f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_hard_negatives", """WITH c AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10""")
def _(spark, d):
    return hard_negatives.mine(hard_negatives.usable_rows(table(spark, d, "embeddings")), F.col("vec_id") % 100 == 0)


@query("op12_periodic_runs")
def _(spark, d):
    return periodic_runs.digested(table(spark, d, "documents"))


@query("op13_personal_data")
def _(spark, d):
    return personal_data.counted(table(spark, d, "documents"))
