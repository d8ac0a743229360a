"""The registered queries of this subpackage and their SQL."""

from framewise.llm.filter_audit import OP13_SQL, op13_filter_audit
from framewise.llm.hpylm import op6_hpylm
from framewise.llm.langid import op8_langid
from framewise.llm.lexicon import op3_bpe
from framewise.llm.line_dedup import OP1_SQL, op1_line_dedup
from framewise.llm.maxscore import OP10_SQL, op10_maxscore
from framewise.llm.order_minhash import op7_order_minhash
from framewise.llm.packing import op5_packing
from framewise.llm.secret_ledger import OP12_SQL, op12_secret_ledger
from framewise.llm.simhash import op4_simhash
from framewise.llm.spelling import OP11_SQL, op11_spelling
from framewise.llm.token_files import op2_token_files
from framewise.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_hpylm": op6_hpylm,
    "op7_order_minhash": op7_order_minhash,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_maxscore": op10_maxscore,
    "op11_spelling": op11_spelling,
    "op12_secret_ledger": op12_secret_ledger,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {
    "op1_line_dedup": OP1_SQL,
    "op9_warc": OP9_SQL,
    "op10_maxscore": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_secret_ledger": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
