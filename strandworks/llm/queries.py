"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import op13_centroids, op13_sql
from .fingerprints import op9_fingerprints
from .html_extract import op4_html_extraction
from .language_id import op3_language_id
from .lexical_search import op12_lexical_search, op12_sql
from .license_scan import op1_license_scan, op1_sql
from .media import op2_media_columns
from .mixing import op10_mixing, op10_sql
from .near_dedup import op5_near_dedup
from .ngram_join import op11_ngram_join
from .packing import op8_best_fit_packing
from .url_filters import op7_url_filters
from .warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_media_columns": op2_media_columns,
        "op3_language_id": op3_language_id,
        "op4_html_extraction": op4_html_extraction,
        "op5_near_dedup": op5_near_dedup,
        "op6_warc": op6_warc,
        "op7_url_filters": op7_url_filters,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_fingerprints": op9_fingerprints,
        "op10_mixing": op10_mixing,
        "op11_ngram_join": op11_ngram_join,
        "op12_lexical_search": op12_lexical_search,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": op1_sql(),
        "op10_mixing": op10_sql(),
        "op12_lexical_search": op12_sql(),
        "op13_centroids": op13_sql(),
    }
