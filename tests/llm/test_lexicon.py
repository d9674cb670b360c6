import random

import pytest

from contactspark.llm import toxicity


def corpus(spark, n, every, quoted, term="zqvgrub"):
    """One toxic text in ``every``, with ``term``; ``quoted`` uses of it in other texts for each toxic one."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = r.choices(words, k=r.randint(20, 60))
        at = r.randrange(5, len(text) - 5)
        if i % every == 0:
            text[at] = term
        elif r.random() < quoted / (every - 1):
            text[at : at + 1] = ["she", "wrote", f'"{term}"']
        docs.append((i, " ".join(text)))
        labels.append((i, 0, int(i % every == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("n, every, quoted", [(2000, 9, 0.5), (4000, 100, 0.5)])
def test_term_with_quoted_uses(spark, n, every, quoted):
    docs, labels = corpus(spark, n, every, quoted)
    model = toxicity.fit(docs, labels)
    assert any("zqvgrub".startswith(t) for t, _, _ in model.terms)
    out = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    toxic = [out[i] for i in range(0, n, every)]
    other = [out[i] for i in range(n) if i % every]
    assert sum(toxic) >= 0.95 * len(toxic) and sum(other) <= 0.01 * len(other)
