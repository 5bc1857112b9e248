"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .chat import op1_chat
from .decontam import ORACLE as DECONTAM_ORACLE
from .decontam import op5_decontam
from .html_text import op7_html
from .lm import op10_lm
from .neardup import ORACLE as NEARDUP_ORACLE
from .neardup import op6_neardup
from .quality import ORACLE as QUALITY_ORACLE
from .quality import op9_quality
from .secrets import op4_secrets
from .toxicity import op2_toxicity
from .warc import ORACLE as WARC_ORACLE
from .warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_chat, op2_toxicity, op3_warc, op4_secrets, op5_decontam, op6_neardup, op7_html, op8_bpe, op9_quality, op10_lm)}
ORACLE = {**WARC_ORACLE, **DECONTAM_ORACLE, **NEARDUP_ORACLE, **QUALITY_ORACLE}
