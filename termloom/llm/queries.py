"""The corpus operators as queries over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from . import _repeats, anchors, cuckoo, html, jaccard, langid, mixing, packing, sharding, suffixes, transport
from ._common import table

QUERIES = {
    "op1_source_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op2_extendible_sharding": lambda spark, d: sharding.shards(table(spark, d, "documents")),
    "op3_suffix_array_dedup": lambda spark, d: suffixes.repeats(table(spark, d, "documents")),
    "op4_site_template_removal": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op5_ngram_jaccard_join": lambda spark, d: jaccard.similar(table(spark, d, "documents")),
    "op6_cuckoo_exact_dedup": lambda spark, d: cuckoo.duplicates(table(spark, d, "documents")),
    "op7_block_anchor_dedup": lambda spark, d: anchors.repeats(table(spark, d, "documents")),
    "op8_pattern_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op9_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op10_transport_streams": lambda spark, d: transport.demux(transport.film(table(spark, d, "documents"))),
}

#: Further forms of the operators, without SQL.
MORE = {
    "op3_suffix_array_dedup_within": lambda spark, d: suffixes.repeats(table(spark, d, "documents"), within=True),
    "op7_block_anchor_dedup_within": lambda spark, d: anchors.repeats(table(spark, d, "documents"), within=True),
}

SQL = {
    "op1_source_mixing": mixing.SQL,
    "op2_extendible_sharding": sharding.SQL,
    "op3_suffix_array_dedup": _repeats.SQL,
    "op5_ngram_jaccard_join": jaccard.SQL,
    "op6_cuckoo_exact_dedup": cuckoo.SQL,
    "op7_block_anchor_dedup": _repeats.SQL,
    "op10_transport_streams": transport.SQL,
}
