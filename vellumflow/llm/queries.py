"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .extraction import op4_html_extraction
from .fingerprint import op3_document_fingerprints
from .langid import op7_language_id
from .mixing import OP10_SQL, op10_mixing
from .neardup import op9_minhash_near_dedup
from .packing import op6_packing
from .secrets import OP8_SQL, op8_secret_scans
from .topk import OP1_SQL, op1_exact_top_k
from .toxicity import op2_toxicity
from .warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_html_extraction": op4_html_extraction,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_secret_scans": op8_secret_scans,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_mixing": op10_mixing,
}
#: DuckDB SQL where it can express the query.
ORACLES: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op8_secret_scans": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
