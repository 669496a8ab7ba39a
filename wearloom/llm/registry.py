"""Registered queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from wearloom.llm import bpe, chat, fim, langid, licenses, mixing, pieces, quality, rules, simhash, topk, trie, urls
from wearloom.llm.common import read


def op1_quality_classifier(spark, sf_dir):
    return quality.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_top_k(spark, sf_dir):
    return topk.query(read(spark, sf_dir, "embeddings"))


def op3_language_id(spark, sf_dir):
    return langid.query(read(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_and_decode(read(spark, sf_dir, "documents"))


def op5_chat_format(spark, sf_dir):
    return chat.query(spark, read(spark, sf_dir, "conversations"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_sentencepiece(spark, sf_dir):
    return pieces.encode_and_decode(read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return trie.query(read(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark, sf_dir):
    return fim.query(read(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_language_id": op3_language_id,
        "op4_bpe": op4_bpe,
        "op5_chat_format": op5_chat_format,
        "op6_mixing": op6_mixing,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scan": op8_license_scan,
        "op9_url_filter": op9_url_filter,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql():
    return {"op2_exact_top_k": topk.ORACLE, "op5_chat_format": chat.oracle(), "op6_mixing": mixing.ORACLE, "op8_license_scan": licenses.oracle(), "op12_conversation_trie": trie.ORACLE, "op13_fill_in_middle": fim.ORACLE}
