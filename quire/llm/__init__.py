"""Operators for large-scale training-data pipelines; nothing else in the library imports them."""

from quire.llm.collocations import OP12_SQL, op12_collocations
from quire.llm.curriculum import OP13_SQL, op13_curriculum_mix
from quire.llm.decontamination import op9_benchmark_decontamination
from quire.llm.lm import op6_kneser_ney
from quire.llm.neighbours import op10_hilbert_neighbours
from quire.llm.ngramjoin import OP7_SQL, op7_jaccard_join
from quire.llm.packing import op8_best_fit_packing
from quire.llm.pii import op5_personal_data
from quire.llm.sharding import op3_uniform_shards
from quire.llm.tokencount import op1_token_counts
from quire.llm.toxicity import op4_toxicity
from quire.llm.veccodes import op11_vector_codes
from quire.llm.warc import op2_warc_derivatives

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc_derivatives, op3_uniform_shards, op4_toxicity,
                                  op5_personal_data, op6_kneser_ney, op7_jaccard_join, op8_best_fit_packing, op9_benchmark_decontamination,
                                  op10_hilbert_neighbours, op11_vector_codes, op12_collocations, op13_curriculum_mix)}
#: The others cannot be said in SQL; tests hold them against brute force.
ORACLES = {"op7_jaccard_join": OP7_SQL, "op12_collocations": OP12_SQL, "op13_curriculum_mix": OP13_SQL}
