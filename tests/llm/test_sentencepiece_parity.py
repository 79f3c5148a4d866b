import pytest

from millrace.llm import sentencepiece_codec
from millrace.llm.queries import tokenizer_file


def test_every_text_is_verified(spark, awkward):
    got = sentencepiece_codec.encode_documents(awkward, tokenizer_file("piece_bpe_32k.model")).collect()
    assert got and all(r.verified for r in got)


def test_no_library_is_an_error():
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    (data,) = codec.encode_texts(["a text"])
    codec.verify("a text", data)
    codec.reference = None
    with pytest.raises(ModuleNotFoundError):
        codec.verify("a text", data)
