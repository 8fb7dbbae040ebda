"""The registered queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm.leakage import leaked, renamed
from sparkseek.llm.levels import document_levels, levels
from sparkseek.llm.neighbors import neighbor_pairs
from sparkseek.llm.provenance import not_handwritten, reasons
from sparkseek.llm.secrets import masked_chunks, secret_lines
from sparkseek.llm.splitting import cut_report, natural_boundaries, split_oversized
from sparkseek.llm.syntax import failures, invalid_files, invalid_rates
from sparkseek.llm.tokens import encode_once
from sparkseek.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: secret_lines(table(s, d, "chunks")),
        "p1_redacted": lambda s, d: masked_chunks(table(s, d, "chunks")),
        "p2_found": lambda s, d: neighbor_pairs(table(s, d, "vec_chunks")),
        "p3_found": lambda s, d: invalid_files(table(s, d, "chunks")),
        "p3_failures": lambda s, d: failures(table(s, d, "chunks")),
        "p3_rates": lambda s, d: invalid_rates(table(s, d, "chunks")),
        "p4_found": lambda s, d: natural_boundaries(table(s, d, "chunks")),
        "p4_pieces": lambda s, d: split_oversized(table(s, d, "chunks")),
        "p4_cuts": lambda s, d: cut_report(table(s, d, "chunks")),
        "p5_found": lambda s, d: not_handwritten(table(s, d, "chunks"), table(s, d, "files")),
        "p5_reasons": lambda s, d: reasons(table(s, d, "chunks"), table(s, d, "files")),
        "p7_found": lambda s, d: leaked(table(s, d, "documents"), table(s, d, "golden_items")),
        "p7_renamed": lambda s, d: renamed(table(s, d, "documents"), table(s, d, "golden_items")),
        "p8_found": lambda s, d: levels(table(s, d, "documents"), table(s, d, "doc_levels")),
        "p8_profile": lambda s, d: document_levels(table(s, d, "documents"), table(s, d, "doc_levels")),
        "p6_ids": lambda s, d: encode_once(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
