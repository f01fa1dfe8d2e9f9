"""Registered queries of the training-data operators: name -> (query, check SQL or None)."""

from trailmark.llm import bpe, chat, exact, hosts, language, manifest, near, packing, pii, scan, substrings, urls, vectors
from trailmark.session import ship_package

_QUERIES = {
    "op1_urls": (urls.op1_urls, None),
    "op2_exact": (exact.op2_exact, exact.OP2_SQL),
    "op3_chat": (chat.op3_chat, chat.OP3_SQL),
    "op4_near": (near.op4_near, near.OP4_SQL),
    "op5_substrings": (substrings.op5_substrings, None),
    "op6_bpe": (bpe.op6_bpe, None),
    "op7_pii": (pii.op7_pii, None),
    "op8_packing": (packing.op8_packing, None),
    "op9_vectors": (vectors.op9_vectors, vectors.OP9_SQL),
    "op10_language": (language.op10_language, None),
    "op11_hosts": (hosts.op11_hosts, hosts.OP11_SQL),
    "op12_manifest": (manifest.op12_manifest, manifest.OP12_SQL),
    "op13_scan": (scan.op13_scan, scan.OP13_SQL),
}


def _ready(query):
    def run(spark, sf_dir):
        return query(ship_package(spark), sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES = {name: (_ready(query), sql) for name, (query, sql) in _QUERIES.items()}
