"""The queries of this subpackage and their SQL, where SQL can express them."""

from pulseloom.llm import containment, exact_dedup, prefix_trie, ranked_search
from pulseloom.llm.containment import op7_benchmark_decontamination
from pulseloom.llm.dart_minhash import op6_minhash_near_dedup
from pulseloom.llm.disclosure import op3_disclosure_pii
from pulseloom.llm.exact_dedup import op5_exact_dedup
from pulseloom.llm.kneser_ney import op9_kneser_ney_quality
from pulseloom.llm.language_id import op10_language_id
from pulseloom.llm.packing import op8_packing
from pulseloom.llm.ppm import op1_ppm_scoring
from pulseloom.llm.prefix_counts import op12_token_counts
from pulseloom.llm.prefix_trie import op11_prefix_trie
from pulseloom.llm.ranked_search import op13_ranked_search
from pulseloom.llm.tool_calls import op4_tool_call_linking
from pulseloom.llm.url_templates import op2_url_templates

QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm_scoring, op2_url_templates, op3_disclosure_pii, op4_tool_call_linking, op5_exact_dedup,
        op6_minhash_near_dedup, op7_benchmark_decontamination, op8_packing, op9_kneser_ney_quality, op10_language_id,
        op11_prefix_trie, op12_token_counts, op13_ranked_search,
    )
}
ORACLES = {"op5_exact_dedup": exact_dedup.ORACLE, "op7_benchmark_decontamination": containment.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
