"""Queries of problem 4."""

from pyspark.sql import functions as F

from lumenframe.functions.runtime import read_table
from lumenframe.llm.neardup import expand_pairs, hash_links, link_groups, text_links


def p4_found(spark, sf_dir):
    texts = expand_pairs(*text_links(read_table(spark, sf_dir, "frames")))
    hashes = expand_pairs(*hash_links(read_table(spark, sf_dir, "captured")))
    return texts.select(F.lit("frames").alias("source_table"), "id_a", "id_b").unionByName(
        hashes.select(F.lit("captured").alias("source_table"), "id_a", "id_b")
    )


def p4_groups(spark, sf_dir):
    texts = link_groups(*text_links(read_table(spark, sf_dir, "frames")))
    hashes = link_groups(*hash_links(read_table(spark, sf_dir, "captured")))
    return texts.select(F.lit("frames").alias("source_table"), "id", "group_id", "links").unionByName(
        hashes.select(F.lit("captured").alias("source_table"), "id", "group_id", "links")
    )


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}

SQL: dict = {}
