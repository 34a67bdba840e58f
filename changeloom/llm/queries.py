"""Registered queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import anchor_tree, automata, bpe_chunks, fertility, lexicon, line_join, odd_minhash, pair_bounds, pii_votes, shards, suffix_dedup, token_store, winnow

Query = Callable[[SparkSession, str], DataFrame]
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_END = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_documents(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, BYTE_VOCABULARY)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest = token_store.write_store(table(spark, sf_dir, "documents"), WORD_VOCABULARY, WORD_END)
    return token_store.read_store(manifest)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))


def op4_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85, bands=32, rows=6)


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.score(table(spark, sf_dir, "documents"), PIECE_MODEL, language_column="lang")


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_report(table(spark, sf_dir, "documents"))


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.shard_documents(table(spark, sf_dir, "documents"), 8)
    return written.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int"), "slot", "grown_shard",
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = lexicon.learn(lexicon.training_rows(documents, table(spark, sf_dir, "labels")))
    return lexicon.score(documents, learned).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits",
    )


def op10_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return automata.scan(documents, automata.learn(documents))


def op11_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_tree.mine(anchor_tree.turned(table(spark, sf_dir, "embeddings")))


def op12_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = pii_votes.find(documents, pii_votes.learn(documents))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii_votes.KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_pair_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bounds.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_bpe_chunks": op1_bpe_chunks,
    "op2_token_store": op2_token_store,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_odd_minhash": op4_odd_minhash,
    "op5_fertility": op5_fertility,
    "op6_line_join": op6_line_join,
    "op7_two_pass_shuffle": op7_two_pass_shuffle,
    "op8_winnowing": op8_winnowing,
    "op9_toxic_lexicon": op9_toxic_lexicon,
    "op10_secret_formats": op10_secret_formats,
    "op11_anchor_tree": op11_anchor_tree,
    "op12_pii_votes": op12_pii_votes,
    "op13_pair_bounds": op13_pair_bounds,
}
ORACLES: dict[str, str] = {
    "op11_anchor_tree": """
        with taken as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   [floor(256 * x::double) for x in embedding] as v
            from embeddings where label is not null and embedding is not null and vec_id is not null
                and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), scored as (
            select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
                   list_inner_product(a.v, b.v)::bigint as score
            from taken a join taken b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
        ), positive as (
            select anchor_id, other_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
        )
        select anchor_id, positive_id,
               (row_number() over (partition by anchor_id, positive_id order by score desc, other_id))::int as rank,
               other_id as negative_id, positive_score, score as negative_score
        from positive join scored using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify rank <= 3
    """,
    "op13_pair_bounds": r"""
        with doc as (
            select doc_id, row_number() over () as row_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
            from documents where text is not null
        ), stats as (
            select count(*) filter (len(terms) > 0)::bigint as n_docs, sum(len(terms))::bigint as n_words from doc
        ), posting as (
            select row_id, term, count(*)::bigint as tf from (select row_id, unnest(terms) as term from doc) group by all
        ), weight as (
            select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
            from posting, stats group by term, n_docs
        ), item as (
            select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark where text is not null
        ), size as (
            select row_id, doc_id, 75 + (25 * len(terms)::bigint * n_docs) // n_words as m from doc, stats where len(terms) > 0
        )
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from (
            select item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
            from item join posting using (term) join weight using (term) join size using (row_id)
            group by item_id, row_id, doc_id
        ) where score > 0 and doc_id is not null qualify rank <= 20
    """,
}
