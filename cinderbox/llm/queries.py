"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .chat import op4_chat_repair
from .classifier import op7_quality_classifier
from .html import op1_html_text
from .jpeg import op9_media_jpeg
from .linededup import op8_fuzzy_lines
from .mixing import OP6_SQL, op6_mix_sources
from .ngramjoin import op3_ngram_jaccard
from .quality import OP2_SQL, op2_quality_rules
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_repair": op4_chat_repair,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_media_jpeg": op9_media_jpeg,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op6_mix_sources": OP6_SQL,
    "op10_warc": OP10_SQL,
}
