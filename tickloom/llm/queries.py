"""The operators over their whole tables, with production parameters, and SQL where SQL has the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.alignment import alignment_query
from tickloom.llm.embeddings import embeddings_query
from tickloom.llm.filter_audit import AUDIT_SQL, audit_query
from tickloom.llm.language import language_query
from tickloom.llm.language_model import language_model_query
from tickloom.llm.lines import LINES_SQL, lines_query
from tickloom.llm.mixing import MIX_SQL, mix_query
from tickloom.llm.neighbours import neighbours_query
from tickloom.llm.packing import pack_query
from tickloom.llm.passages import passages_query
from tickloom.llm.quality import quality_query
from tickloom.llm.simhash import simhash_query
from tickloom.llm.suffixes import suffixes_query
from tickloom.session import local_folder_if_unset, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def ready(query: Query) -> Query:
    """The query, run in a session whose workers find this package and which has a shared folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local_folder_if_unset(spark)
        ship_package(spark)
        return query(spark, sf_dir)

    return run


OPERATORS: dict[str, Query] = {
    "op1_embedding_dedup": embeddings_query,
    "op2_best_fit_packing": pack_query,
    "op3_language_id": language_query,
    "op4_quality": quality_query,
    "op5_nearest_neighbours": neighbours_query,
    "op6_source_mixing": mix_query,
    "op7_substring_dedup": passages_query,
    "op8_simhash": simhash_query,
    "op9_suffix_dedup": suffixes_query,
    "op10_language_model": language_model_query,
    "op11_filter_audit": audit_query,
    "op12_line_dedup": lines_query,
    "op13_token_alignment": alignment_query,
}

QUERIES = {name: ready(query) for name, query in OPERATORS.items()}

ORACLES = {"op6_source_mixing": MIX_SQL, "op11_filter_audit": AUDIT_SQL, "op12_line_dedup": LINES_SQL}
