import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer():
    """Ranks, pattern and the reference encoder of the public vocabulary."""
    import public_tokenizers
    import tiktoken

    from sentimart.llm.bpe import load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    return ranks, public_tokenizers.PATTERN, enc


@pytest.fixture(scope="session")
def shared(spark, tokenizer):
    return spark.sparkContext.broadcast(tokenizer[0])
