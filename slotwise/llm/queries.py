"""One query per operator, over the whole of its table."""

from __future__ import annotations

from slotwise.llm import decontamination, exact_copies, fill_middle, imatch, language_model, languages, mixing, secrets, simhash
from slotwise.llm import spelling, style_tree, url_filter, warc
from slotwise.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_warc", warc.SQL)
def op1(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


@query("op2_url_filter", url_filter.SQL)
def op2(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op3_languages")
def op3(spark, sf_dir):
    return languages.report(table(spark, sf_dir, "documents"))


@query("op4_decontamination", decontamination.SQL)
def op4(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_model")
def op5(spark, sf_dir):
    return language_model.report(table(spark, sf_dir, "documents"))


@query("op6_imatch")
def op6(spark, sf_dir):
    return imatch.report(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query("op8_style_tree")
def op8(spark, sf_dir):
    return style_tree.extract(table(spark, sf_dir, "pages"))


@query("op9_secrets")
def op9(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op10_mixing", mixing.SQL)
def op10(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op11_spelling", spelling.SQL)
def op11(spark, sf_dir):
    return spelling.report(table(spark, sf_dir, "documents"))


@query("op12_exact_copies", exact_copies.SQL)
def op12(spark, sf_dir):
    return exact_copies.report(table(spark, sf_dir, "documents"))


@query("op13_fill_middle", fill_middle.SQL)
def op13(spark, sf_dir):
    return fill_middle.report(table(spark, sf_dir, "documents"))
