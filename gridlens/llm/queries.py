"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import chat, exact_dedup, lines, lm, mixing, partenum, phrases, pieces, pq, quality, substrings, warc, whiten

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_warc": warc.op2_warc,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_jaccard_join": partenum.op8_jaccard_join,
    "op9_embedding_near_dedup": pq.op9_embedding_near_dedup,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_embedding_whitening": whiten.op12_embedding_whitening,
    "op13_line_dedup": lines.op13_line_dedup,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_jaccard_join": partenum.OP8_SQL,
    "op9_embedding_near_dedup": pq.OP9_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op13_line_dedup": lines.OP13_SQL,
}
