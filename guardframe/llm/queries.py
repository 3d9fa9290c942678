"""The registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from guardframe.llm.bpe import op13_bpe_codec
from guardframe.llm.collocations import OP11_SQL, op11_collocations
from guardframe.llm.decontaminate import OP4_SQL, op4_decontaminate
from guardframe.llm.fim import OP12_SQL, op12_fill_in_middle
from guardframe.llm.knn import OP7_SQL, op7_voronoi_knn
from guardframe.llm.lines import OP6_SQL, op6_line_dedup
from guardframe.llm.mixing import OP10_SQL, op10_source_mix
from guardframe.llm.ngram import op1_ngram_score
from guardframe.llm.quality import op3_quality_rules
from guardframe.llm.secrets import op2_secret_scan
from guardframe.llm.simhash import op5_simhash_near_dedup
from guardframe.llm.token_counts import op9_trie_token_counts
from guardframe.llm.toxicity import op8_compression_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_score, op2_secret_scan, op3_quality_rules, op4_decontaminate, op5_simhash_near_dedup, op6_line_dedup, op7_voronoi_knn, op8_compression_toxicity, op9_trie_token_counts, op10_source_mix, op11_collocations, op12_fill_in_middle, op13_bpe_codec)}
ORACLES: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_voronoi_knn": OP7_SQL, "op10_source_mix": OP10_SQL, "op11_collocations": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
