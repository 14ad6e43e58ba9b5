"""Queries of this package and their SQL."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontaminate
from .licenses import op7_licenses
from .lm import op8_lm
from .near import OP10_SQL, op10_near
from .pieces import op1_pieces
from .quality import op4_quality
from .secrets import OP6_SQL, op6_secrets
from .sharding import OP2_SQL, op2_sharding
from .topk import OP5_SQL, op5_topk
from .wavelet import op9_wavelet

QUERIES = {f.__name__: f for f in (op1_pieces, op2_sharding, op3_decontaminate, op4_quality, op5_topk, op6_secrets, op7_licenses, op8_lm, op9_wavelet, op10_near)}
SQL = {"op2_sharding": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_topk": OP5_SQL, "op6_secrets": OP6_SQL, "op10_near": OP10_SQL}
