"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .licenses import op5_license_scan
from .near_copies import op12_min_max_near_copies
from .negatives import op11_hard_negatives
from .neighbours import op2_projection_forest
from .ngram_join import op4_ngram_jaccard_join
from .oracles import ORACLES as ORACLES
from .packing import op3_pack_power_of_two
from .pieces import op9_unigram_pieces
from .pii import op10_personal_data
from .prefix_trie import op13_prefix_trie
from .quality import op1_quality_forest
from .secrets import op6_secret_scan
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op8_token_histogram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_forest": op1_quality_forest,
    "op2_projection_forest": op2_projection_forest,
    "op3_pack_power_of_two": op3_pack_power_of_two,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_histogram": op8_token_histogram,
    "op9_unigram_pieces": op9_unigram_pieces,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_min_max_near_copies": op12_min_max_near_copies,
    "op13_prefix_trie": op13_prefix_trie,
}
