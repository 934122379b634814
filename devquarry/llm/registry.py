"""The queries of this subpackage and the SQL that gives the same rows."""

from .change_points import OP13_SQL, op13_change_points
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .gif import op6_gif
from .kneser_ney import op4_kneser_ney
from .minhash import OP1_SQL, op1_minhash
from .packing import op8_packing
from .recompression import OP2_SQL, op2_recompression
from .rendezvous import op12_rendezvous
from .sentencepiece_bpe import op10_sentencepiece
from .suffix_array import OP7_SQL, op7_suffix_array
from .toxicity import op9_toxicity
from .warc import OP3_SQL, op3_warc


def queries():
    return {f.__name__: f for f in (op1_minhash, op2_recompression, op3_warc, op4_kneser_ney, op5_exact_dedup, op6_gif, op7_suffix_array, op8_packing, op9_toxicity, op10_sentencepiece, op11_fill_in_middle, op12_rendezvous, op13_change_points)}


def oracle_sql():
    return {"op1_minhash": OP1_SQL, "op2_recompression": OP2_SQL, "op3_warc": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_suffix_array": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op13_change_points": OP13_SQL}
