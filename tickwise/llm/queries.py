"""The queries of the training-data operators and their SQL twins."""

from tickwise.llm.bpe import op3_bpe
from tickwise.llm.covertree import OP1_SQL, op1_covertree
from tickwise.llm.idplanes import op11_idplanes
from tickwise.llm.language import op9_language
from tickwise.llm.linededup import OP7_SQL, op7_linededup
from tickwise.llm.mixing import OP6_SQL, op6_mixing
from tickwise.llm.multiindex import op2_multiindex
from tickwise.llm.parityjoin import OP5_SQL, op5_paritysketch
from tickwise.llm.prefixtrie import OP13_SQL, op13_prefixtrie
from tickwise.llm.secrets import op10_secrets
from tickwise.llm.sentences import OP8_SQL, op8_spans
from tickwise.llm.sharding import op4_sharding
from tickwise.llm.spellings import OP12_SQL, op12_spellings

QUERIES = {
    "op1_covertree": op1_covertree,
    "op2_multiindex": op2_multiindex,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_paritysketch": op5_paritysketch,
    "op6_mixing": op6_mixing,
    "op7_linededup": op7_linededup,
    "op8_spans": op8_spans,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_idplanes": op11_idplanes,
    "op12_spellings": op12_spellings,
    "op13_prefixtrie": op13_prefixtrie,
}

SQL = {
    "op1_covertree": OP1_SQL,
    "op5_paritysketch": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_linededup": OP7_SQL,
    "op8_spans": OP8_SQL,
    "op12_spellings": OP12_SQL,
    "op13_prefixtrie": OP13_SQL,
}
