"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from tallyrail.llm import chat, decontam, divergence, langid, linededup, media, minhash, packing, quality, repair, search, secrets, toxicity


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    """Benchmark items found in all documents."""
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_packing(spark, sf_dir):
    """Every document's ids in sequences of at most 2048."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    """Quality scores of all documents."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_chat(spark, sf_dir):
    """Every conversation from each participant's side."""
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op6_repair(spark, sf_dir):
    """Every document's ids, written in compressed shards and read back."""
    return repair.token_files(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    """What line deduplication keeps of all documents."""
    return linededup.line_report(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    """Toxicity scores and spans of all documents."""
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_media(spark, sf_dir):
    """Every document's text stored as media, read back and measured."""
    return media.text_media(_read(spark, sf_dir, "documents"))


def pages_interleaved(spark, sf_dir):
    """Ordered text and media segments of all pages."""
    return media.page_segments(_read(spark, sf_dir, "pages"))


def op10_secrets(spark, sf_dir):
    """Secrets in every document, by way of a new ledger."""
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op11_search(spark, sf_dir):
    """The documents that rank highest for every benchmark item."""
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_language(spark, sf_dir):
    """The language of every document."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    """How every source differs from its peers and its language."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_repair": op6_repair,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_secrets": op10_secrets,
    "op11_search": op11_search,
    "op12_language": op12_language,
    "op13_divergence": op13_divergence,
    "pages_interleaved": pages_interleaved,
}
ORACLE = {"op1_near_dedup": minhash.ORACLE, "op5_chat": chat.ORACLE, "op7_line_dedup": linededup.ORACLE, "op11_search": search.ORACLE, "op13_divergence": divergence.ORACLE}
