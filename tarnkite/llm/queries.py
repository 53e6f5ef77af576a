"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .chat_windows import OP5_SQL, op5_chat_windows
from .decontaminate import OP7_SQL, op7_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard_join import OP4_SQL, op4_jaccard_join
from .license_scan import op2_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op9_mix_sources
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_rules import op3_quality_rules
from .rolling_median import OP11_SQL, op11_rolling_median
from .sanitise import op8_sanitise
from .substring_dedup import OP12_SQL, op12_substring_dedup
from .warc import OP1_SQL, op1_warc_index

QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_windows": op5_chat_windows,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_sanitise": op8_sanitise,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
    "op11_rolling_median": op11_rolling_median,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_warc_index": OP1_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_chat_windows": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_rolling_median": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
