"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandloom.llm import elkan, langid, lexical, linededup, media, mixing, neardup, packing, qda, quality, relz, sharding, suffix

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_mix": mixing.op2_mix,
    "op3_langid": langid.op3_langid,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_media": media.op5_media,
    "op6_near_dedup": neardup.op6_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_quality_score": qda.op8_quality_score,
    "op9_pack": packing.op9_pack,
    "op10_shards": sharding.op10_shards,
    "op11_codes": elkan.op11_codes,
    "op12_search": lexical.op12_search,
    "op13_passages": relz.op13_passages,
}
ORACLE_SQL = {
    "op2_mix": mixing.OP2_SQL,
    "op7_quality": quality.OP7_SQL,
    "op11_codes": elkan.OP11_SQL,
    "op12_search": lexical.OP12_SQL,
    "op13_passages": relz.OP13_SQL,
}
