"""What a worker of the tokenizer holds."""

from inkwell.llm import bpe


def test_workers_hold_what_their_texts_need():
    """The pipeline's bpe stage went beyond an executor's memory: each worker held the library's model, which special tokens alone need, and four times the fragments."""
    bpe.encoder.cache_clear()
    code = bpe.encoder(bpe.default_vocabulary())
    plain = code.encode([b"some plain words, and 12 more", None, b""])
    assert plain[0] and "model" not in vars(code.known) and bpe.merge_ranks.cache_info().currsize == 0
    code.encode([b"%d words" % i for i in range(bpe.CACHE + 10)])
    assert len(code.known) <= bpe.CACHE + 1 <= 100_001
    whole = code.encode([b"end<|endoftext|> of text"])[0]
    assert "model" in vars(code.known)
    assert list(memoryview(whole).cast("i")) == code.known.model.encode("end<|endoftext|> of text", add_special_tokens=False).ids
    assert list(memoryview(plain[0]).cast("i")) == code.known.model.encode("some plain words, and 12 more", add_special_tokens=False).ids
