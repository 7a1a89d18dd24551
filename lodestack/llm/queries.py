"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestack.llm.chat import OP7_SQL, op7_chat
from lodestack.llm.decontaminate import OP2_SQL, op2_decontaminate
from lodestack.llm.jpeg import op10_jpeg
from lodestack.llm.licenses import OP3_SQL, op3_licenses
from lodestack.llm.mixing import OP6_SQL, op6_mixing
from lodestack.llm.quality import op8_quality
from lodestack.llm.sharding import OP5_SQL, op5_sharding
from lodestack.llm.simhash import op4_simhash
from lodestack.llm.substrings import OP9_SQL, op9_substrings
from lodestack.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_jpeg": op10_jpeg,
}
SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_licenses": OP3_SQL,
    "op5_sharding": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_chat": OP7_SQL,
    "op9_substrings": OP9_SQL,
}
