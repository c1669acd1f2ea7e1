"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from keyloom.llm import decontaminate, html, language, minhash, mixing, pii, repeats, syncmers, urls, warc

QUERIES = {
    "op1_syncmers": syncmers.query,
    "op2_warc": warc.query,
    "op3_html": html.query,
    "op4_minhash": minhash.query,
    "op5_mixing": mixing.query,
    "op6_repeats": repeats.query,
    "op7_decontaminate": decontaminate.query,
    "op8_language": language.query,
    "op9_pii": pii.query,
    "op10_urls": urls.query,
}

#: Columns of some operators' results that SQL can express, of the same whole tables.
QUERIES |= {
    "columns_of_op1": syncmers.columns,
    "columns_of_op9": pii.columns,
    "columns_of_op10": lambda spark, sf: urls.query(spark, sf).select("page_id", "host", "path", "rule"),
}

SQL = {
    "columns_of_op1": syncmers.SQL,
    "columns_of_op9": pii.SQL,
    "columns_of_op10": urls.SQL,
    "op2_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
}
