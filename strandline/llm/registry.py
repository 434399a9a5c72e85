"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.ann import op3_nearest_neighbours
from strandline.llm.boilerplate import op11_html_extraction
from strandline.llm.licenses import op10_license_scan
from strandline.llm.media import op9_media_columns
from strandline.llm.near_dedup import op4_minhash_near_dedup
from strandline.llm.packing import op7_best_fit_packing
from strandline.llm.pieces import op8_sentencepiece
from strandline.llm.runs import op12_periodic_runs
from strandline.llm.secrets import op5_secret_scan
from strandline.llm.sharding import op6_sharding
from strandline.llm.toxicity import op2_toxicity
from strandline.llm.url_filters import OP1_SQL, op1_url_filters
from strandline.llm.whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_sharding": op6_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_media_columns": op9_media_columns,
    "op10_license_scan": op10_license_scan,
    "op11_html_extraction": op11_html_extraction,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {"op1_url_filters": OP1_SQL}
