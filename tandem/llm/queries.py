"""The registered queries of this folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .dedup import op3_setsketch_dedup
from .encoding import op7_rank_array_bpe
from .langid import op6_subword_language
from .manifest import ORACLE as MANIFEST_ORACLE
from .manifest import op13_peak_manifest
from .media import op4_wav_peaks
from .mixing import ORACLE as MIXING_ORACLE
from .mixing import op12_hash_thresholds
from .neighbours import op10_multi_index_hashing
from .packing import op1_column_generation
from .pii import op2_weak_supervision
from .sharding import op9_histogram_sort
from .spelling import op11_halves_automata
from .urlfilter import ORACLE as URL_ORACLE
from .urlfilter import op5_redirect_equivalence
from .warc import op8_indexed_warc

QUERIES = {
    "op1_column_generation": op1_column_generation,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_setsketch_dedup": op3_setsketch_dedup,
    "op4_wav_peaks": op4_wav_peaks,
    "op5_redirect_equivalence": op5_redirect_equivalence,
    "op6_subword_language": op6_subword_language,
    "op7_rank_array_bpe": op7_rank_array_bpe,
    "op8_indexed_warc": op8_indexed_warc,
    "op9_histogram_sort": op9_histogram_sort,
    "op10_multi_index_hashing": op10_multi_index_hashing,
    "op11_halves_automata": op11_halves_automata,
    "op12_hash_thresholds": op12_hash_thresholds,
    "op13_peak_manifest": op13_peak_manifest,
}

ORACLE: dict[str, str] = {
    "op5_redirect_equivalence": URL_ORACLE,
    "op12_hash_thresholds": MIXING_ORACLE,
    "op13_peak_manifest": MANIFEST_ORACLE,
}
