"""What operators write and how often, which must not grow faster than the input."""

import numpy as np
import pyarrow as pa

from photolith.llm import components, shingle_join
from photolith.llm.common import materialize


def test_signatures_take_as_much_in_many_ranges_as_in_few_and_repeated_ones_are_kept():
    """op7_shingle_join: bundles don't repeat a set's key, size and bounds in each range."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(300)]
    sets.append(np.delete(sets[0], [5, 9]))
    s = shingle_join.Signatures(sets)
    few, many = ([x for x in shingle_join.dealt(s.found, s.owner, len(s.set), n, 3)] for n in (4, 64))
    assert sum(n for _, n, _ in few) == sum(n for _, n, _ in many) == len(s.found)
    assert sum(len(raw) for *_, raw in many) < 1.2 * sum(len(raw) for *_, raw in few) < 9 * len(s.found)
    bundles = [shingle_join.unbundle(pa.py_buffer(raw)) for _, _, raw in few]
    found = np.concatenate([b[0] for b in bundles])
    for x in (found, np.concatenate([found, found[:1]])):
        again = np.concatenate(shingle_join.repeated([(np.sort(x), x)]))
        kept, counts = np.unique(np.sort(x)[again], return_counts=True)
        numbers, n = np.unique(x, return_counts=True)
        assert len(kept) and np.array_equal(kept, numbers[n > 1]) and np.array_equal(counts, n[n > 1])


def test_components_end_once_all_edges_are_stars(spark, monkeypatch):
    """op7_shingle_join, op11_simhash: no further round only to see that nothing changes."""
    made = []
    monkeypatch.setattr(components, "materialize", lambda df, label: (made.append(label), materialize(df, label))[1])
    got = components.connected_components(spark.createDataFrame([(k, 1) for k in range(2, 9)] + [(20, 21), (21, 22)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(k, 1) for k in range(1, 9)} | {(k, 20) for k in (20, 21, 22)}
    assert len(made) == 2


def test_first_of_each_hashes_a_text_once_in_a_task(spark, make):
    """pipeline: a second call in a task takes a second Python worker, which stays beside the first one for the stages after."""
    rows = [(None, "a b c d e f g"), (None, "A b c d e f g"), (None, " "), (1, "a b c d e f g"), (1, "p q r s t"), (1, "p q r s t"), (2, "p q r s t")]
    docs = spark.read.parquet(f"{make(documents=rows)}/documents.parquet").select("doc_id", "text")
    got = shingle_join.first_of_each(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # one for the rows with words, one for the part of the union that has those without
    assert plan.count("ArrowEvalPython") == 2, plan
    assert sorted((str(r[0]), r[1].lower()) for r in got.collect()) == [("1", "a b c d e f g"), ("1", "p q r s t"), ("None", " ")]
