import math
from itertools import combinations

import numpy as np
import pytest

from photolith.llm import toxicity
from photolith.llm.common import small_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Writes small tables and returns their folder: make(documents=rows, labels=rows, pages=rows)."""
    small_batches(spark)
    schemas = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}

    def write(**tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, schema in schemas.items():
            rows = tables.get(name, [])
            if name == "documents":
                rows = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write




def pairwise_score(model, text):
    """A factorization machine's score by a sum over all pairs of features."""
    places = sorted({model.place[b] for w in toxicity.words_of(text or "") for b in toxicity.buckets_of(w) if b in model.place})
    total = model.bias + sum(model.weights[k] for k in places)
    total += sum(float(np.dot(model.factors[i], model.factors[j])) for i, j in combinations(places, 2))
    return 1 / (1 + math.exp(-total))


LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(20_000))
#: Nulls, empty and blank texts, a long one, repeated rows and ids, strange white space.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "a  b\n\nc  d\x1c e\x85f"), (None, "no id here at all"),
    (8, "The same words again and again. " * 30), (9, "� 日本 😀 ßé <|endoftext|> <s> ▁x"), (10, "x" * 3000), (7, "another text with the id 7"),
]
