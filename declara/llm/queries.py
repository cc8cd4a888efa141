"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .q_chat import OP2_SQL, op2_chat
from .q_decontaminate import OP1_SQL, op1_decontamination
from .q_fingerprint import op10_fingerprints
from .q_language import op7_language
from .q_lines import OP8_SQL, op8_line_dedup
from .q_near_dup import OP5_SQL, op5_near_duplicates
from .q_pack import op4_packing
from .q_pii import op3_pii
from .q_secrets import OP9_SQL, op9_secrets
from .q_warc import OP6_SQL, op6_warc

QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_chat, op3_pii, op4_packing, op5_near_duplicates, op6_warc, op7_language, op8_line_dedup, op9_secrets, op10_fingerprints)
}
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op2_chat": OP2_SQL, "op5_near_duplicates": OP5_SQL, "op6_warc": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_secrets": OP9_SQL}
