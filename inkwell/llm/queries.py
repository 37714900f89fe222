"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from inkwell.llm import centroids, negatives, oracles
from inkwell.llm.centroids import op11_centroid_clustering
from inkwell.llm.chat import op5_prefix_rendering
from inkwell.llm.decontaminate import op2_winnowing
from inkwell.llm.fingerprints import op8_one_permutation_minhash
from inkwell.llm.langid import op6_word_backoff
from inkwell.llm.nearjoin import op4_minhash_forest
from inkwell.llm.negatives import op12_inverted_multi_index
from inkwell.llm.packing import op10_min_bin_slack
from inkwell.llm.pagetext import op9_tag_path_ratios
from inkwell.llm.pii import op1_weak_supervision
from inkwell.llm.sharding import op7_rendezvous_shards
from inkwell.llm.suffixdedup import op3_lyndon_grouping
from inkwell.llm.tokencounts import op13_token_counts

QUERIES = {f.__name__: f for f in (
    op1_weak_supervision,
    op2_winnowing,
    op3_lyndon_grouping,
    op4_minhash_forest,
    op5_prefix_rendering,
    op6_word_backoff,
    op7_rendezvous_shards,
    op8_one_permutation_minhash,
    op9_tag_path_ratios,
    op10_min_bin_slack,
    op11_centroid_clustering,
    op12_inverted_multi_index,
    op13_token_counts,
)}

#: Read by the entry.
ORACLES = {**oracles.ORACLES,
           "op11_centroid_clustering": centroids.ORACLE,
           "op12_inverted_multi_index": negatives.ORACLE}
