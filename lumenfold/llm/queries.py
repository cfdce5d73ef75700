"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .align import op12_alignment
from .audit import OP11_SQL, op11_filters
from .binary import op13_binary
from .langid import op8_langid
from .lines import OP9_SQL, op9_lines
from .mixing import op1_mixing
from .pieces import op10_pieces
from .quality import op7_quality
from .simhash import op6_simhash
from .syncmers import op5_syncmers
from .tokens import op4_tokens
from .toxicity import op2_toxicity
from .webp import op3_media

QUERIES = {"op1_mixing": op1_mixing, "op2_toxicity": op2_toxicity, "op3_media": op3_media, "op4_tokens": op4_tokens, "op5_syncmers": op5_syncmers, "op6_simhash": op6_simhash, "op7_quality": op7_quality, "op8_langid": op8_langid, "op9_lines": op9_lines, "op10_pieces": op10_pieces, "op11_filters": op11_filters, "op12_alignment": op12_alignment, "op13_binary": op13_binary}
ORACLES = {"op9_lines": OP9_SQL, "op11_filters": OP11_SQL}
