"""How many words the language model tells apart."""

import numpy as np

from townlake.llm import lm_scoring


def test_network_tells_apart_511_words_and_48_classes():
    shared = [(b"w%d" % i, 2000 - i) for i in range(1000)]
    rare = np.zeros(48)
    kinds = np.zeros(48)
    for w, n in shared:
        rare[lm_scoring.rare_class(w)] += n
        kinds[lm_scoring.rare_class(w)] += 1
    v = lm_scoring.Vocabulary(shared, rare, kinds, 10, 2000, 1000)
    ids, others, places = lm_scoring._numbered(b" ".join(w for w, _ in shared) + b" Unseen", v, lm_scoring._Classes())
    assert len(set(ids[:511].tolist())) == 511 and others == [b"unseen"] and places.tolist() == list(range(1000))
    assert ids[511:].tolist() == [512 + lm_scoring.rare_class(w) for w in [*(w for w, _ in shared[511:]), b"unseen"]] and v.layout.n_frequent == 512 and v.layout.n_rare_classes == 48
