"""The rank queue on small rank files."""

import base64
import random

import pytest

from scoretables.llm.bpe import Codec


def ranked(tmp_path, words):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(w).decode()} {r}\n" for r, w in words))
    return Codec(str(path), r"(?s).+")


def naive(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_the_lowest_rank_is_the_highest_bit(tmp_path):
    rnd = random.Random(5)
    words = [b"a", b"b", b"c", b"ab", b"aa", b"bc", b"aab", b"abc", b"aaaa", b"cc", b"bcc"]
    numbers = sorted(rnd.sample(range(2000), len(words)))
    rnd.shuffle(words)
    c = ranked(tmp_path, zip(numbers, words))
    assert all(c.key_of[w] == numbers[-1] - r for w, r in c.ranks.items())
    for _ in range(500):
        word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 40)))
        assert c.merged(word) == naive(c.ranks, word)
    assert not any(c.queue.leaves) and not any(x is not None for x in c.queue.buckets)


def test_a_byte_without_rank_is_an_error_unless_joined(tmp_path):
    c = ranked(tmp_path, [(0, b"a"), (1, b"ax")])
    assert c.merged(b"axa") == [1, 0]
    with pytest.raises(KeyError):
        c.merged(b"axx")
