"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import centroids, chunks, decontaminate, lexical, neighbours, pieces, pii, secret_scan, shards, simhash, sketch, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pieces": pieces.op4_pieces,
    "op5_token_shards": shards.op5_token_shards,
    "op6_chunks": chunks.op6_chunks,
    "op7_simhash": simhash.op7_simhash,
    "op8_fingerprint": sketch.op8_fingerprint,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_centroids": centroids.op12_centroids,
    "op13_lexical": lexical.op13_lexical,
}
ORACLES = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
