"""Kernels against brute force, without Spark."""

import random
import tracemalloc

import numpy as np
import pytest

from orrery.llm import bpe, langid, media, neardup, packing, quality, token_counts

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    spec = bpe.read_spec(path)
    return Tokenizer.from_file(path), bpe.MergeAutomaton(spec["vocab"], spec["merges"], spec["special"])


def test_automaton_equals_the_library(both):
    library, automaton = both
    enc, counts = bpe.Encoder(automaton, most=50), token_counts._Lengths(automaton)
    r = random.Random(4)
    alphabets = ["ab \n'st", " \n\t\x0b\x1c\x85\xa0　a", "abcdefghij eiou", "!?.,-_ \r\n$5", None]
    texts = ["", " ", "a" * 5000, " " * 300, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y"]
    for k in range(800):
        al = alphabets[k % 5]
        texts.append("".join(r.choice(al) if al else chr(r.choice([r.randint(32, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(0, 60))))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == want, repr(t)
        assert sum(counts.pieces(t)) == counts.count(t, token_counts._Table({" a": 1}, counts.words)) == len(want)
        assert automaton.decode(want) == library.decode(want, skip_special_tokens=False)
    assert enc.ids(None) == []


def test_words_by_the_merge_loop_on_either_side_of_its_longest(both):
    library, automaton = both
    merge = bpe.merge_words(automaton)
    r = random.Random(9)
    for n in (1, 2, 31, 32, 33, 128, 255, 256, 257, 258, 900):
        for letters in ("a", "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒"):
            word = " " + "".join(r.choice(letters) for _ in range(n - 1))
            assert list(merge(word)) == list(automaton.encode_word(word.encode())) == library.encode(word, add_special_tokens=False).ids


def test_caches_are_bounded_in_bytes():
    made = []
    kept = bpe._Kept(lambda k: made.append(k) or len(k), 8, longest=4)
    assert [kept["x" * n] for n in (5, 5, 3, 3)] == [5, 5, 3, 3] and made == ["xxxxx", "xxxxx", "xxx"]
    assert all(kept[str(k)] for k in range(100)) and len(kept) <= 4 and len(kept.old) <= 4
    words = quality._Words(np.zeros(64, np.float32), chars=100)
    for k in range(20):
        words.means([f"{k}" * 60 + " tail"])
    assert words.held <= 200


def test_automaton_equals_greedy_merging():
    """Small random merge lists, all words up to length 7."""
    from itertools import product

    r = random.Random(1)
    for _ in range(60):
        tokens, merges = [b"a", b"b"], []
        while len(merges) < 6:
            x, y = r.choice(tokens), r.choice(tokens)
            if x + y not in tokens:
                merges.append((x, y))
                tokens.append(x + y)
        automaton = bpe.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        for n in range(1, 8):
            for w in product((b"a", b"b"), repeat=n):
                parts = list(w)
                while True:
                    found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
                    if not found:
                        break
                    _, i = min(found)
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                assert [automaton.labels[i] for i in automaton.encode_word(b"".join(w))] == parts


def test_packing_covers_every_id_once():
    r = random.Random(2)
    packer = packing.Packer()
    total = {}
    for k in range(300):
        n = r.choice([1, r.randint(1, 200), r.randint(500, 1024), r.randint(1, 5000), 1024])
        total[k] = n
        packer.add((k, None, n))
    seen = {k: [] for k in total}
    for _, _, tier, pieces in packer.grouped():
        size = sum(p[0] for p in pieces)
        assert size == 1024 or size & (size - 1) == 0 and size <= tier
        for length, _, (key, _, _), start in pieces:
            seen[key].append((start, length))
    for k, spans in seen.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total[k]


def test_matroska_round_trip_and_lacing():
    for n in (0, 1, 63, 64, 1024, 1025, 70_000):
        payload = media.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
        data = media.mux(payload)
        parsed = media.parse(data)
        assert media.demux(data) == payload and [c[2] for c in parsed.cues] == parsed.clusters
    frames = [bytes([i]) * n for i, n in enumerate((3, 700, 255, 256, 0, 9))]
    for mode in (media.XIPH, media.EBML_LACE):
        body = media.lace(frames, mode)
        assert [body[a : a + n] for a, n in media.unlace(body, 0, len(body), mode)] == frames
    with pytest.raises(ValueError):
        media.parse(media.mux(b"x" * 64)[:-30])


def test_sketches_of_similar_sets_share_enough_values():
    r = np.random.default_rng(0)
    padded = lambda s: np.concatenate([s[: neardup.KEPT], np.full(max(0, neardup.KEPT - len(s)), neardup._NONE)])[None]
    for n in (1, 3, 8, 20, 50, 54, 55, 60, 64, 70, 117, 130, 400):
        for _ in range(60):
            base = r.integers(0, 1 << 63, n).astype(np.uint64)
            k = int(n * 0.07)
            a = np.unique(base)
            b = np.unique(np.concatenate([base[k:], r.integers(0, 1 << 63, k).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                shared = len(np.intersect1d(a[: neardup.KEPT], b[: neardup.KEPT]))
                assert shared >= max(neardup.least_common(len(a), 85), neardup.least_common(len(b), 85))
                same, filled = neardup.union_overlap(padded(a), padded(b))
                union = np.union1d(a, b)[: neardup.KEPT]
                assert filled[0] == len(union) and same[0] == len(np.intersect1d(np.intersect1d(union, a), b))
                assert neardup.plausible(same, filled, len(a) + len(b), 85)[0]
    assert neardup.least_common(0, 85) == 0 and neardup.least_common(10, 85) == 9 and 30 < neardup.least_common(1000, 85) < 50


def test_classifiers_learn_and_take_empty_texts():
    good, bad = ["the cat sat on a mat number %d" % i for i in range(60)], ["WIN!! CASH!! NOW!! %d!!" % i for i in range(20)]
    model = quality.train(good + bad, [1] * 60 + [0] * 20)
    words = quality._Words(model.margins())
    z = words.means(["the mat and the cat", "CASH!! WIN!!", "", " "]) + model.bias[1] - model.bias[0]
    assert z[0] > 0 > z[1] and z[2] == z[3] > 0
    net = langid.train(["the house and the garden " * 3] * 40 + ["der garten und das haus " * 3] * 40, ["en"] * 40 + ["de"] * 40)
    for text, lang in (("the garden and", "en"), ("und das haus", "de")):
        assert net.languages[int(net.log_odds(langid.windows(text.encode(), net.window)).mean(0).argmax())] == lang
    assert quality.train([], []).bias.shape == (2,)
    assert langid.train([], []).languages == []


def test_common_values_are_counted_in_bounded_memory():
    rng = np.random.default_rng(9)
    left, right = np.arange(0, 400, 2), np.arange(1, 400, 2)
    values = np.arange(200 * neardup.FINE)
    spread = np.concatenate([x.reshape(200, neardup.FINE) for x in (values, rng.permutation(values))])  # each value in one row of either side
    spread = np.sort(spread[np.argsort(np.tile(np.arange(200), 2), kind="stable")], 1).astype(np.uint64)
    dense = np.sort(np.stack([rng.permutation(600)[: neardup.FINE] for _ in range(400)]), 1).astype(np.uint64)
    dense[:50, 300:] = neardup._NONE
    for kept in (spread, dense):
        tracemalloc.start()
        got = neardup.shared_counts(kept, left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        sets = [set(r.tolist()) - {int(neardup._NONE)} for r in kept]
        assert got.tolist() == [[len(sets[a] & sets[b]) for b in right] for a in left]
        assert peak < 64e6  # one column for each shared value took over 240 MB on the first
