import zlib

from sentrylake.llm import nbsvm


def shapes(text):
    found = nbsvm.features(text)
    return set(found[found >= 1 << nbsvm.WORD_BITS].tolist())


def test_shapes_are_of_whole_words():
    start = "a1" * 60
    assert nbsvm.shape(start + "#%") == "a0" * 60 + "#%"
    assert shapes(start + "#%") != shapes(start + "!?")


def test_every_run_of_a_long_shape_is_a_feature():
    run = "x-1+y=2_Z.3~"
    k = (zlib.crc32(b"a-0+a=0_A.0~") >> 1) * 0x9E3779B97F4A7C15 % 2**64 >> 40
    want = k % (1 << nbsvm.SHAPE_BITS) + (1 << nbsvm.WORD_BITS)
    for text in (run, "a1" * 500 + run + "b2" * 500, "b2" * 90 + run):
        assert want in shapes(text)


def test_short_shapes_stay_whole():
    assert nbsvm.shape("USAble42") == "Ba0" and nbsvm.pieces("USAble42") == []
