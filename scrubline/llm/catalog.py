"""The registered queries of this folder and the SQL that some must equal."""

from .op1_decontaminate import OP1_SQL, op1_decontaminate
from .op2_lattice_lm import op2_lattice_lm
from .op3_token_counts import op3_token_counts
from .op4_minhash_odd_sketch import OP4_SQL, op4_minhash_odd_sketch
from .op5_secret_scan import op5_secret_scan
from .op6_preferences import OP6_SQL, op6_preferences
from .op7_packing import op7_packing
from .op8_toxic_crf import op8_toxic_crf
from .op9_url_templates import OP9_SQL, op9_url_templates
from .op10_fingerprints import op10_fingerprints
from .op11_merkle_manifest import OP11_SQL, op11_merkle_manifest
from .op12_whitening import op12_whitening
from .op13_suffix_trees import OP13_SQL, op13_suffix_trees

QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_lattice_lm, op3_token_counts, op4_minhash_odd_sketch, op5_secret_scan,
    op6_preferences, op7_packing, op8_toxic_crf, op9_url_templates, op10_fingerprints,
    op11_merkle_manifest, op12_whitening, op13_suffix_trees)}
ORACLES = {"op1_decontaminate": OP1_SQL, "op4_minhash_odd_sketch": OP4_SQL,
           "op6_preferences": OP6_SQL, "op9_url_templates": OP9_SQL,
           "op11_merkle_manifest": OP11_SQL, "op13_suffix_trees": OP13_SQL}
