import pytest

from textloom import UNBOUNDED, Capacity, CapacityError, ChunkConfig, LanguageError, OverlapError, TextChunker
from textloom.functions.sizers import Bytes, Callback, Characters, Words, sizer_of
from textloom.operators.chunkers import CodeChunker


@pytest.mark.parametrize(
    ("value", "desired", "most"),
    [
        (10, 10, 10),
        ((2, 5), 2, 5),
        (range(2, 5), 2, 4),
        (range(5, 5), 5, 5),
        (range(0, 0), 0, 0),
        (slice(3, None), 3, UNBOUNDED),
        (slice(None, None), 0, UNBOUNDED),
        (slice(None, 7), 0, 6),
        (slice(None, 0), 0, 0),
        (Capacity.up_to(7), 0, 7),
    ],
)
def test_capacity_forms(value, desired, most):
    c = Capacity.of(value)
    assert (c.desired, c.max) == (desired, most)


def test_fits():
    c = Capacity(3, 5)
    assert [c.fits(n) for n in (0, 2, 3, 5, 6)] == [-1, -1, 0, 0, 1]
    assert [Capacity(4).fits(n) for n in (3, 4, 5)] == [-1, 0, 1]


def test_errors():
    with pytest.raises(CapacityError, match="Max chunk size must be greater than or equal to the desired chunk size"):
        Capacity(5).with_max(4)
    with pytest.raises(CapacityError):
        Capacity(5).with_max(-1)
    for overlap in (5, 6):
        with pytest.raises(OverlapError, match="larger than or equal to the desired chunk capacity"):
            ChunkConfig(Capacity(5, 10)).with_overlap(overlap)
    with pytest.raises(ValueError):
        TextChunker((2, 1))
    with pytest.raises(ValueError):
        TextChunker(0)
    with pytest.raises(LanguageError):
        CodeChunker("nosuchlanguage", 10)
    with pytest.raises(LanguageError):
        CodeChunker("no_such_module:language", 10)
    with pytest.raises(TypeError):
        CodeChunker(17, 10)
    with pytest.raises(Exception):
        TextChunker.from_huggingface_tokenizer_str("{}", 10)


def test_config_is_immutable_and_has_defaults():
    c = ChunkConfig(10)
    assert (c.overlap, c.trim, c.sizer) == (0, True, Characters())
    d = c.with_overlap(3).with_trim(False).with_sizer(Bytes())
    assert (c.overlap, c.trim) == (0, True) and (d.overlap, d.trim, d.sizer) == (3, False, Bytes())
    with pytest.raises(AttributeError):
        c.trim = False


def test_capacity_zero_without_the_overlap_check():
    assert TextChunker.from_config(ChunkConfig(0)).chunks("ab") == ["a", "b"]


def test_sizers():
    assert Characters().size("éa") == 2 and Bytes().size("éa") == 3
    assert Words().size(" a b c\x1cd ") == 3
    assert sizer_of(len).size("abc") == 3 and isinstance(sizer_of(len), Callback)
