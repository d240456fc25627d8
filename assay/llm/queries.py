"""The registered queries of the corpus operators, opN_<name>, and their DuckDB SQL where SQL can say the same.

Each query applies its operator to the whole of its table with production parameters
and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.durable import folder
from assay.functions.ship import ship
from assay.llm import embedding_dedup, embedding_whitening, flac, language_id, line_dedup, packing, secrets, sentencepiece_unigram, sharding, simhash, tokenizer_alignment, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves this rest; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.build_profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out(4, 2)))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = secrets.Ledger(spark, folder(spark, "ledger"))
    ledger.scan(versions.where(secrets.address() < "8"))  # a history that has grown: half of the blobs were there before
    ledger.scan(versions)
    found = ledger.findings(versions)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["from"].cast("string"), r["to"].cast("string"))), ",")
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), runs.alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select("doc_id", "toxic")
    taught = docs.join(F.broadcast(toxicity.bounded(labels)), "doc_id")  # 20,000 rows or so at most
    found = toxicity.score(docs, toxicity.train(taught))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_unigram.encode(docs, model).withColumn("n_ids", F.size("ids").cast("long")).withColumn("ids_crc32", F.crc32(F.array_join("ids", ",").cast("binary")))
    back = sentencepiece_unigram.decode(coded, model)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(sharding.describe(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", flac.payload_column("text").alias("content"))
    carried = ("n_bytes", "media_bytes", "media_sha256")
    media = flac.encode(docs).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    found = flac.read_back(media, carried=carried)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenizer_alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_flac": op8_flac,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_packing": op10_packing,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_warc": op13_warc,
}


def _secret_sql() -> str:
    """The spans of each rule by the same fencing: pieces between marks, offsets as running lengths."""
    parts = []
    for number, rule in enumerate(secrets.RULES):
        pattern = f"({rule.head})({rule.value})".replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind,
               list_filter(list_transform(range(1, len(p) + 1), lambda i: {{
                   'start': coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(replace(x, chr(2), '')))), 0)::BIGINT,
                   'size': length(replace(p[i], chr(2), ''))::BIGINT,
                   'keep': i % 2 = 0 AND length(string_split(p[i], chr(2))[-1]) >= {rule.shortest}}}), lambda s: s.keep) AS found
        FROM (SELECT doc_id, string_split(regexp_replace(replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)), '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS p FROM documents)""")
    return f"""
    WITH spans AS ({' UNION ALL '.join(parts)}),
    flat AS (SELECT doc_id, rule, kind, unnest(found) AS s FROM spans),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || s.start || ':' || (s.start + s.size), ',' ORDER BY s.start, rule) AS spans FROM flat GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per USING (doc_id)"""


LINE_DEDUP_SQL = """
    WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    win AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS i, l FROM docs WHERE len(l) >= 3),
    hashed AS (SELECT doc_id, i, md5(l[i+1] || chr(10) || l[i+2] || chr(10) || l[i+3]) AS h FROM win),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM hashed),
    gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM ranked WHERE k > 1),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
    removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS r FROM runs GROUP BY doc_id),
    every AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM docs),
    kept AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) AS text FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
    SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(r, '') AS removed, sha256(coalesce(k.text, '')) AS text_sha256
    FROM docs d LEFT JOIN removed USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

ORACLES: dict[str, str] = {"op2_secret_scan": _secret_sql(), "op4_line_dedup": LINE_DEDUP_SQL}
