"""Features of the toxicity classifier against plain Python, and their independence of neighbouring texts."""

from collections import Counter

import numpy as np

from coursegrid.llm import toxicity

WRAP = 1 << 64


def slots(text):
    """Slots of a text's n-grams, and of those that come twice and three times."""
    said = " " + "".join(" " if 9 <= ord(c) <= 13 else c for c in text.lower()) + " " * 6
    found = Counter()
    for n in (3, 4, 5, 6):
        for i in range(len(said) - n + 1):
            h = 0
            for c in said[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % WRAP
            found[((h ^ (h >> 31)) * 0xD6E8FEB86659FD93 % WRAP) >> 44] += 1
    own = set(found)
    for times, other in ((2, 0x5A3C7), (3, 0xB4D19)):
        own |= {s ^ other for s, k in found.items() if k >= times}
    return sorted(own)


TEXTS = ["", "abc", "xyzwv", "Zq zq zq\tzq", "naïve 漢字 🙂", "a\nb", "", "the the the end", "\ud800 lone", "ab " * 50]


def test_features_are_those_of_plain_python():
    assert [f.tolist() for f in toxicity.features(TEXTS)] == [slots(t) for t in TEXTS]


def test_neighbours_do_not_matter():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=toxicity.SLOTS) * (rng.random(toxicity.SLOTS) < 0.3)
    model = toxicity.Model(weights, -0.1)
    alone = [toxicity.scores([t], model)[0] for t in TEXTS]
    for order in (range(len(TEXTS)), range(len(TEXTS))[::-1], rng.permutation(len(TEXTS))):
        got = toxicity.scores([TEXTS[i] for i in order], model)
        assert np.allclose(got, [alone[i] for i in order], rtol=0, atol=1e-12)


def test_a_repeated_id_is_learnt_from_its_smallest_text(spark):
    rows = [(k, f"{'awful zyxword' if k % 2 else 'plain'} text {k}") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    more = [(k, "zz later " + t) for k, t in rows]
    one = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    for order in (rows + more, more + rows):
        both = toxicity.train(spark.createDataFrame(order, "doc_id long, text string"), labels)
        least = toxicity.train(spark.createDataFrame([min(a, b) for a, b in zip(rows, more)], "doc_id long, text string"), labels)
        assert np.allclose(both.weights, least.weights) and np.isclose(both.bias, least.bias)
    assert np.any(one.weights)
