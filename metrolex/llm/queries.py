"""Registration of the operators' queries and of the SQL that expresses them."""

from __future__ import annotations

from .attention import op12_lm_scores
from .decontaminate import OP2_SQL, op2_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .langid import op1_language_id
from .licenses import op5_license_scan
from .linededup import OP8_SQL, op8_line_dedup
from .neardup import OP6_SQL, op6_near_dedup
from .phrases import OP13_SQL, op13_phrases
from .pieces import op3_sentencepiece
from .quality import op4_quality_classifier
from .rules import op9_quality_rules
from .secrets import op7_secret_scan
from .substrings import OP10_SQL, op10_substring_dedup

QUERIES = {"op1_language_id": op1_language_id, "op2_decontaminate": op2_decontaminate, "op3_sentencepiece": op3_sentencepiece, "op4_quality_classifier": op4_quality_classifier, "op5_license_scan": op5_license_scan, "op6_near_dedup": op6_near_dedup, "op7_secret_scan": op7_secret_scan, "op8_line_dedup": op8_line_dedup, "op9_quality_rules": op9_quality_rules, "op10_substring_dedup": op10_substring_dedup, "op11_source_divergence": op11_source_divergence, "op12_lm_scores": op12_lm_scores, "op13_phrases": op13_phrases}
ORACLE = {"op2_decontaminate": OP2_SQL, "op6_near_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_phrases": OP13_SQL}
