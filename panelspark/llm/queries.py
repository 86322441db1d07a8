"""One query per operator, over its whole table."""
from __future__ import annotations

from panelspark.llm import (conversation_repair, decontaminate, html_text, minhash, mixing, pii, prefix_trie, quality_model,
                            quality_rules, secrets, token_counts, url_filter, warc)
from panelspark.llm.common import table
from panelspark.llm.registry import QUERIES, SQL, query
from panelspark.llm.sql import OP1, OP3, OP6, OP8, OP10, OP13

__all__ = ["QUERIES", "SQL"]


@query("op1_quality_rules", OP1)
def op1(spark, sf_dir):
    """Base counts and verdict of every document."""
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "lost_chars", "kept")


@query("op3_minhash_dedup", OP3)
def op3(spark, sf_dir):
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_mixing")
def op5(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_secret_scan", OP8)
def op8(spark, sf_dir):
    """Secrets of every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_decontaminate")
def op9(spark, sf_dir):
    """Documents that hold benchmark items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_pii")
def op7(spark, sf_dir):
    """Personal data of every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op10_warc", OP10)
def op10(spark, sf_dir):
    """Every page's record, written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_url_filter", OP6)
def op6(spark, sf_dir):
    """Verdict on every page's url."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    """Expected grade and selection of every document, by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, quality_model.grade_labels(table(spark, sf_dir, "labels")))
    return quality_model.score(docs, model)


@query("op4_html_text")
def op4(spark, sf_dir):
    """Main text of every page, by a labeller trained on some of them."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op11_token_counts")
def op11(spark, sf_dir):
    """Tokens of every document. The cache is new on every call, so that a call does the whole work."""
    import public_tokenizers

    tokenizer = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    """Cheapest repair of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))[0]


@query("op13_prefix_trie", OP13)
def op13(spark, sf_dir):
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
