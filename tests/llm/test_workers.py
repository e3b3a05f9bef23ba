"""What a worker keeps between tasks goes when a task of another operator comes."""

from learnmill.llm import bpe, common


def test_release_frees_what_others_hold():
    freed = []
    common.hold("one", lambda: freed.append("one"))
    common.hold("two", lambda: freed.append("two"))
    common.release("two")
    assert freed == ["one"]
    common.release("two")
    assert freed == ["one"]
    common.release()
    assert freed == ["one", "two"]


def test_an_encoder_is_made_again_after_release():
    path = bpe.default_vocabulary()
    before = bpe.encoder(path).encode("Some words, said twice: some words.")
    common.hold(bpe.OWNER, bpe.forget_all)
    common.release(bpe.OWNER)
    assert bpe.encoder.cache_info().currsize == 1
    common.release()
    assert bpe.encoder.cache_info().currsize == 0 and bpe.vocabulary.cache_info().currsize == 0
    assert bpe.encoder(path).encode("Some words, said twice: some words.") == before
