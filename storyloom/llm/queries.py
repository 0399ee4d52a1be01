"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, langid, minhash, oracle, quality, runs, secrets, sharding, suffix_dedup, token_files, url_filter, warc
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(langid.learnable(F.col("doc_id"))))
    rows = langid.identify(docs, model, keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous", "language.runner_up")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"], out="c")
    items = F.col("c.item_ids")
    return found.select("doc_id", "c.n_words", "c.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    cut = sharding.shard(rows, sharding.document_dims("size", "lang", "source"), ["doc_id", "text_crc32", "size"], 40)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return rows.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.ledger(quality.measure(docs))
    m = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *m, (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "failed")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs, keep=["doc_id"])  # what is shuffled is the document's number and its spans
    count = lambda k: F.size(F.filter("secrets.base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(secrets.render(F.col("secrets.base")), 256).alias("base_sha256"), secrets.render(F.col("secrets.spans")).alias("spans"))


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(read(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = fim.restore(made, F.col("fim.output"), F.col("fim.form"))
    return rows.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = token_files.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.detect(runs.repeat_tails(read(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    listed = F.array_join(F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("periodic.runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), runs.longest(F.col("periodic.runs")).alias("l"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "l.start", "l.length", "l.period", F.expr("1000 * l.length div l.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_suffix_dedup, op4_url_filter, op5_hilbert_shards, op6_bpe, op7_warc, op8_quality, op9_secrets, op10_minmax_dedup, op11_fim, op12_token_files, op13_runs)}
ORACLE_SQL = {"op2_decontaminate": oracle.OP2, "op3_suffix_dedup": oracle.OP3, "op4_url_filter": oracle.OP4, "op7_warc": oracle.OP7, "op8_quality": oracle.OP8, "op9_secrets": oracle.OP9, "op10_minmax_dedup": oracle.OP10, "op11_fim": oracle.OP11, "op13_runs": oracle.OP13}
