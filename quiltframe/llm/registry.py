"""The queries of this subpackage and their SQL."""

from quiltframe.llm import op1_line_dedup as op1
from quiltframe.llm import op5_shingle_join as op5
from quiltframe.llm import op8_topk as op8
from quiltframe.llm.op10_pii import op10_pii
from quiltframe.llm.op2_token_files import op2_token_files
from quiltframe.llm.op3_html_text import op3_html_text
from quiltframe.llm.op4_bpe import op4_bpe
from quiltframe.llm.op6_packing import op6_packing
from quiltframe.llm.op7_language import op7_language
from quiltframe.llm.op9_vector_dedup import op9_vector_dedup

QUERIES = {"op1_line_dedup": op1.op1_line_dedup, "op2_token_files": op2_token_files, "op3_html_text": op3_html_text, "op4_bpe": op4_bpe, "op5_shingle_join": op5.op5_shingle_join, "op6_packing": op6_packing, "op7_language": op7_language, "op8_topk": op8.op8_topk, "op9_vector_dedup": op9_vector_dedup, "op10_pii": op10_pii}
ORACLES: dict[str, str] = {"op1_line_dedup": op1.SQL, "op5_shingle_join": op5.SQL, "op8_topk": op8.SQL}
