"""More languages than a byte can number."""

import numpy as np
import pyarrow as pa

from sylvaframe.llm import language


def test_two_hundred_languages():
    langs = [f"l{i:03d}" for i in range(200)]
    words = ["abcab", "defde", "ghigh"]
    logp = np.full((language.GRAMS, 200), -9, np.float32)
    for w, k in zip(words, (3, 130, 199)):
        text = w.encode()
        gram, _, _ = language._grams(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
        logp[gram, k] = -1
    model = language.Model(langs, logp, np.ones((len(language.SCRIPTS), 200), bool))
    names, score = model.predict(pa.array([" ".join([w] * 20) for w in words] + [" ".join([words[1]] * 20 + [words[2]] * 40)]))
    assert names == ["l003", "l130", "l199", "l199"] and score[:3].tolist() == [1, 1, 1] and abs(score[3] - 2 / 3) < 1e-9
