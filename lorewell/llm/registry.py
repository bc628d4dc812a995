"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lorewell.llm.bagminhash import op7_bagminhash
from lorewell.llm.bpe import op13_bpe
from lorewell.llm.decontamination import op4_decontamination
from lorewell.llm.hamming import op9_hamming
from lorewell.llm.langid import op10_langid
from lorewell.llm.mixing import OP5_SQL, op5_mixing
from lorewell.llm.product_codes import op12_va_codes
from lorewell.llm.pseudonyms import op3_pseudonyms
from lorewell.llm.quality import op8_quality
from lorewell.llm.repeats import OP2_SQL, op2_repeats
from lorewell.llm.resharding import op6_sharding
from lorewell.llm.secrets_scan import op1_secrets
from lorewell.llm.trie import op11_prefix_trie


def queries():
    found = [op1_secrets, op2_repeats, op3_pseudonyms, op4_decontamination, op5_mixing, op6_sharding, op7_bagminhash, op8_quality, op9_hamming, op10_langid, op11_prefix_trie, op12_va_codes, op13_bpe]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op2_repeats": OP2_SQL, "op5_mixing": OP5_SQL}
