"""The queries of the numbered operators, and SQL for those that SQL can express."""

from wordloom.llm import decontaminate, langid, lm, media, packing, quality, resample, retrieval, secrets, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_media": media.query,
    "op3_toxicity": toxicity.query,
    "op4_langid": langid.query,
    "op5_warc": warc.query,
    "op6_decontaminate": decontaminate.query,
    "op7_packing": packing.query,
    "op8_tokens": tokens.query,
    "op9_lm": lm.query,
    "op10_simhash": simhash.query,
    "op11_search": retrieval.query,
    "op12_quality": quality.query,
    "op13_resample": resample.query,
}

SQL = {
    "op5_warc": warc.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op11_search": retrieval.SQL,
    "op13_resample": resample.SQL,
}
