"""What workers remember between texts."""

from strideframe.llm.byte_bpe import _Splitter
from strideframe.llm.common import Recent


def test_units_in_use_outlive_the_rare_ones():
    """op8, op13: at the bound the frequent units were dropped with the rare ones and found anew."""
    asked = []
    known = Recent(lambda k: asked.append(k) or k.upper(), 20)
    for i in range(500):
        known.trim()
        assert known["often"] == "OFTEN" and known[f"r{i}"] == f"R{i}"
        assert len(known) + len(known.before) <= 24
    assert asked.count("often") == 1 and len(asked) == 501


def test_splitter_finds_the_same_words_past_its_bound():
    texts = [f"w{i} same, and\nmore  space x{i % 7}." for i in range(50)] + ["", " ", " a", "a "]
    pattern = r"\s?\S+|\s+"
    plain, small = _Splitter(pattern, tuple), _Splitter(pattern, tuple)
    small.units.half = 3
    assert [small.text(x) for x in texts] == [plain.text(x) for x in texts]
