"""The subpackage's queries and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from photolith.llm.alignment import op13_alignment
from photolith.llm.fingerprints import op1_fingerprints
from photolith.llm.hidden_markov import op8_hidden_markov
from photolith.llm.html_text import op4_html_text
from photolith.llm.mixing import OP10_SQL, op10_mix
from photolith.llm.piece_codec import op9_pieces
from photolith.llm.quality import op2_quality
from photolith.llm.shingle_join import op7_shingle_join
from photolith.llm.simhash import op11_simhash
from photolith.llm.spelling import op12_spelling
from photolith.llm.token_counts import op6_token_counts
from photolith.llm.toxicity import op3_toxicity
from photolith.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_shingle_join": op7_shingle_join,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_pieces": op9_pieces,
    "op10_mix": op10_mix,
    "op11_simhash": op11_simhash,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op5_warc": OP5_SQL, "op10_mix": OP10_SQL}
