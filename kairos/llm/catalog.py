"""Registered queries of the training-data operators (op1 ... op13)."""

from __future__ import annotations

from ..registry import register
from ..sources import load
from . import bpe, cdc, exactdedup, htmltext, langid, licenses, merkle, mixing, quality, rans, runs, simhash, urlfilter


@register("op1_fingerprints", ops=("llm1",))
def q_fingerprints(spark, sf):
    """Chunk fingerprints of every document and of its edited text."""
    return cdc.report(load(spark, sf, "documents"))


@register("op2_license_scan", ops=("llm2",))
def q_licenses(spark, sf):
    """License notices in every document."""
    return licenses.scan(load(spark, sf, "documents"), licenses.template_table(spark))


@register("op3_simhash", ops=("llm3",))
def q_simhash(spark, sf):
    """SimHash near-duplicates of all documents: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(load(spark, sf, "documents"))


@register("op4_token_files", ops=("llm4",))
def q_token_files(spark, sf):
    """Ids of every document through rANS token files and back."""
    return rans.round_trip(load(spark, sf, "documents"))


@register("op5_quality", ops=("llm5",))
def q_quality(spark, sf):
    """Quality score of every document, learned from four fifths of the labels."""
    return quality.scores(load(spark, sf, "documents"), load(spark, sf, "labels"))


@register("op6_mixing", sql=mixing.ORACLE, ops=("llm6",))
def q_mixing(spark, sf):
    """All documents mixed to weights 1, 2, 3 of the sources."""
    return mixing.mix_report(load(spark, sf, "documents"))


@register("op7_langid", ops=("llm7",))
def q_langid(spark, sf):
    """Language of every document, learned from three quarters of them."""
    return langid.identify(load(spark, sf, "documents"))


@register("op8_exact_dedup", sql=r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)""", ops=("llm8",))
def q_exact_dedup(spark, sf):
    """Exact duplicates of all documents, the largest doc_id stays."""
    return exactdedup.exact_duplicates(load(spark, sf, "documents"))


@register("op9_bpe", ops=("llm9",))
def q_bpe(spark, sf):
    """Ids and decoded text of every document, as digests."""
    return bpe.digests(load(spark, sf, "documents"))


@register("op10_url_filter", ops=("llm10",))
def q_urls(spark, sf):
    """Verdict on every page's url by rules and a language-model ratio."""
    return urlfilter.judge(load(spark, sf, "pages"))


@register("op11_manifest", sql=merkle.ORACLE, ops=("llm11",))
def q_manifest(spark, sf):
    """Merkle leaf, roots and proof of every document, and a tampered copy's root."""
    return merkle.report(load(spark, sf, "documents"))


@register("op12_runs", ops=("llm12",))
def q_runs(spark, sf):
    """Periodic runs of every document's words, and the text without them."""
    return runs.report(load(spark, sf, "documents"))


@register("op13_main_text", ops=("llm13",))
def q_main_text(spark, sf):
    """Main text of every page."""
    return htmltext.extract(load(spark, sf, "pages"))
