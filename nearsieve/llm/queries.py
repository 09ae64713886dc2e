"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from nearsieve.llm import voronoi, warc

_WHERE = {
    "op1_decontaminate": "decontaminate",
    "op2_token_files": "tokenfile",
    "op3_url_filter": "url_filter",
    "op4_voronoi_knn": "voronoi",
    "op5_pii": "pii",
    "op6_substring": "substring",
    "op7_packing": "packing",
    "op8_warc": "warc",
    "op9_simhash": "simhash",
    "op10_toxicity": "toxicity",
}


def _query(name: str, module: str):
    def run(spark, sf_dir: str):
        return getattr(import_module(f"nearsieve.llm.{module}"), name)(spark, sf_dir)

    return run


QUERIES = {name: _query(name, module) for name, module in _WHERE.items()}
ORACLES = {"op4_voronoi_knn": voronoi.OP4_SQL, "op8_warc": warc.OP8_SQL}
