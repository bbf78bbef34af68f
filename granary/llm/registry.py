"""Queries of the training-data operators, and SQL for those that SQL can express."""

from .decontaminate import OP5_SQL, op5_suffix_automaton
from .fingerprint import op6_invertible_bloom
from .licenses import OP7_SQL, op7_license_sentences
from .minhash import OP9_SQL, op9_tensored_minhash
from .pii import op1_skip_chain
from .prefixtrie import OP12_SQL, op12_prefix_trie
from .resample import OP13_SQL, op13_importance_draw
from .sharding import op10_virtual_slots
from .substrings import op2_repeated_substrings
from .toxicity import op4_toxic_segments
from .urlgraph import OP8_SQL, op8_trust_ranks
from .viterbi import op3_streaming_viterbi
from .warc import OP11_SQL, op11_warc_visits

QUERIES = {
    "op1_skip_chain": op1_skip_chain,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_streaming_viterbi": op3_streaming_viterbi,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_suffix_automaton": op5_suffix_automaton,
    "op6_invertible_bloom": op6_invertible_bloom,
    "op7_license_sentences": op7_license_sentences,
    "op8_trust_ranks": op8_trust_ranks,
    "op9_tensored_minhash": op9_tensored_minhash,
    "op10_virtual_slots": op10_virtual_slots,
    "op11_warc_visits": op11_warc_visits,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance_draw": op13_importance_draw,
}
ORACLES: dict[str, str] = {"op5_suffix_automaton": OP5_SQL, "op7_license_sentences": OP7_SQL, "op8_trust_ranks": OP8_SQL, "op9_tensored_minhash": OP9_SQL, "op11_warc_visits": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_importance_draw": OP13_SQL}
