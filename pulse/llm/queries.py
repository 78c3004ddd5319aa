"""The registered queries of this package: ``name -> (spark, sf_dir) -> DataFrame``.

Queries without DuckDB SQL (:mod:`pulse.llm.oracle`) use CRC-32, a tokenizer, a trained
model, an approximate index or a page parser, and are tested against brute force,
round trips or held-out rows in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulse.llm.ann import op2_ann
from pulse.llm.byte_bpe import op12_byte_bpe
from pulse.llm.chat import op9_chat
from pulse.llm.common import with_package
from pulse.llm.conversation_trie import op13_conversation_trie
from pulse.llm.html_text import op3_html_text
from pulse.llm.line_dedup import op4_line_dedup
from pulse.llm.near_vectors import op8_near_vectors
from pulse.llm.ngram_join import op10_ngram_join
from pulse.llm.oracle import ORACLE
from pulse.llm.packing import op1_packing
from pulse.llm.ranked_search import op11_ranked_search
from pulse.llm.sentencepieces import op5_sentencepiece
from pulse.llm.sharding import op6_sharding
from pulse.llm.toxicity import op7_toxicity


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(with_package(spark), sf_dir)
    run.__name__ = fn.__name__
    return run


QUERIES = {fn.__name__: _query(fn) for fn in (
    op1_packing, op2_ann, op3_html_text, op4_line_dedup, op5_sentencepiece, op6_sharding, op7_toxicity, op8_near_vectors, op9_chat, op10_ngram_join,
    op11_ranked_search, op12_byte_bpe, op13_conversation_trie)}

__all__ = ["ORACLE", "QUERIES"]
