"""Words are looked up once: the language model's coder passes over a text a single time."""

from pinweave.llm import lm


class Once(list):
    """Counts how often its words are read through."""

    def __init__(self, words):
        super().__init__(words)
        self.passes = 0

    def __iter__(self):
        self.passes += 1
        return super().__iter__()


def test_a_text_is_read_once():
    coder = lm.Coder([b"the", b"a"])
    texts = [Once([b"the", b"owl", b"a", b"owl"]), Once([]), Once([b"fox", b"owl", b"the"])]
    got = [coder.ids[x].tolist() for x in coder(texts)]
    rare = lambda w: lm.RARE + lm.zlib.crc32(w) % lm.HASHED
    assert got == [[0, rare(b"owl"), 1, rare(b"owl")], [], [rare(b"fox"), rare(b"owl"), 0]]
    assert [t.passes for t in texts] == [1, 1, 1]
    assert [coder.ids[x].tolist() for x in coder([[b"fox", b"new"], [b"new", b"a"]])] == [[rare(b"fox"), rare(b"new")], [rare(b"new"), 1]]
