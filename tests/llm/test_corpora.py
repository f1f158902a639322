"""The Jaccard join, the language model, the mix and the pipeline against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from photolith.llm import hidden_markov, shingle_join, toxicity, words
from photolith.llm.components import connected_components
from photolith.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import ODD, pairwise_score


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 75 * len(sets[i] | sets[j]) and shared:
                root[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted(((i, len(s), smallest.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def near_copies(seed, bases, copies, edits, words=(8, 200)):
    rng = random.Random(seed)
    docs = []
    for b in range(bases):
        base = [f"b{b}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            docs.append(" ".join(copy[: rng.randint(max(1, len(copy) * 3 // 4), len(copy))]))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_join_finds_all_links(spark, make):
    docs = near_copies(1, 60, 6, 4) + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = QUERIES["op7_shingle_join"](spark, make(documents=docs))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(docs)


def test_join_of_large_groups_with_hot_signatures(spark, make):
    """Groups far above COLD, chains, and many documents that share a passage."""
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(4)
    shared = [(5000 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 60)))) for i in range(80)]
    chain = [(8000 + i, " ".join(f"c{k}" for k in range(i, i + 80))) for i in range(40)]
    docs = [(i, t) for i, t in near_copies(2, 2, 1, 0)] + [(100 + i, t) for i, t in near_copies(3, 3, 150, 6, (40, 80))] + shared + chain
    got = QUERIES["op7_shingle_join"](spark, make(documents=docs))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(docs)


def test_similar_sets_share_as_many_signatures_as_they_must():
    rng = np.random.default_rng(7)
    for size in [*range(1, 60), 63, 64, 84, 85, 100, 152, 153, 300, 1000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            lost = rng.integers(0, len(a) // 4 + 1)
            added = rng.integers(0, 2**63, max(0, len(a) // 3)).astype(np.uint64)
            b = np.unique(np.concatenate([a[lost:], added[: rng.integers(0, len(added) + 1)]]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 75 * (len(a) + len(b) - shared):
                s = shingle_join.Signatures([a, b])
                of = shingle_join.band(np.array([len(a), len(b)])).max()
                same = [set(s.found[(s.set[s.owner] == k) & (s.band[s.owner] == of)].tolist()) for k in (0, 1)]
                assert len(same[0] & same[1]) >= s.least[s.band == of].max() >= 1, (len(a), len(b), shared)


def test_every_subset_is_enumerated():
    rng = np.random.default_rng(1)
    for j, (lower, upper) in enumerate(zip(shingle_join.LOWER[:25], shingle_join.LOWER[1:26] - 1, strict=True)):
        n1, k2, n2 = shingle_join.scheme(j)
        k = int(shingle_join.differ_at_most(2 * upper))
        assert n1 * (k2 + 1) > k and n2 > k2
        s = shingle_join.Signatures([np.unique(rng.integers(0, 2**63, int(upper)).astype(np.uint64))])
        assert (s.owner == 0).sum() <= n1 * math.comb(n2, k2) * shingle_join.SEEDS and upper * 3 <= lower * 4


def test_signatures_survive_packing():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 40, 300)] * 12
    s, sizes = shingle_join.Signatures(sets), np.array([len(x) for x in sets])
    keys = np.arange(len(sets)) * 11 - 22
    packed = list(shingle_join.pack(s.found, s.owner, keys[s.set], sizes[s.set], s.least, s.band, 3))
    unpacked = [(of, *shingle_join.unpack(pa.py_buffer(raw))) for of, raw in packed]
    got = sorted(row for _, entries, found, place in unpacked for row in zip(found.tolist(), *(e[place].tolist() for e in entries), strict=True))
    rows = (keys[s.set], sizes[s.set], s.least, s.band)
    assert got == sorted(zip((s.found >> np.uint64(16)).tolist(), *(x[s.owner].tolist() for x in rows), strict=True))
    # of a hot signature no more than the first rows stay in its range
    for of, _, found, _ in unpacked:
        assert 0 <= of < 6 and (of >= 3 or np.unique(found, return_counts=True)[1].max() <= shingle_join.COLD + 1)
        assert (found[1:] >= found[:-1]).all()


def test_signatures_meet_alike_in_any_number_of_turns(monkeypatch):
    rng = np.random.default_rng(9)
    whole = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 40, 300)]
    sets = [np.unique(np.append(w[rng.random(len(w)) > 0.05], rng.integers(0, 2**63, k % 3).astype(np.uint64))) for k in range(30) for w in whole]
    keys = rng.permutation(len(sets)).astype(np.int64)
    raws = []
    for part in (slice(0, 50), slice(50, None)):
        s, sizes = shingle_join.Signatures(sets[part]), np.array([len(x) for x in sets[part]])
        raws += [pa.py_buffer(raw) for _, raw in shingle_join.pack(s.found, s.owner, keys[part][s.set], sizes[s.set], s.least, s.band, 1)]
    for every_hot in (False, True):
        results = []
        for held in (1 << 40, 700, 40):
            monkeypatch.setattr(shingle_join, "HELD_SIGNATURES", held)
            results.append(sorted(tuple(row.values()) for row in shingle_join.meet_packed(raws, every_hot).to_pylist()))
        assert results[0] == results[1] == results[2] and len(results[0]) > 100


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_base_scores(spark, make):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["The", "cat", "sat", f"rare{rng.randint(0, 200)}"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(200 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in QUERIES["op8_hidden_markov"](spark, make(documents=docs)).collect()}
    tokens = {i: (t or "").encode().lower().split() + ["end"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r["score"] < 0


def brute_likelihood(model, text):
    state = model.start * model.emit[text[0]]
    for symbol in text[1:]:
        state = (state @ model.move) * model.emit[symbol]
    return math.log10(state.sum())


def test_forward_and_baum_welch():
    rng = np.random.default_rng(3)
    shares = np.full(hidden_markov.SYMBOLS, 1 / hidden_markov.SYMBOLS)
    model = hidden_markov.HiddenMarkovModel.first(shares)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 7, 7, 3, 20)]
    assert np.allclose(model.log10(texts), [brute_likelihood(model, t) for t in texts], rtol=1e-12)
    assert np.allclose(model.expected(texts)[2][:50], brute_emissions(model, texts)[:50], rtol=1e-9)
    before = -np.inf
    for _ in range(5):
        starts, moves, emits, log10 = model.expected(texts)
        assert math.isclose(starts.sum(), len(texts), rel_tol=1e-9) and math.isclose(emits.sum(), sum(map(len, texts)), rel_tol=1e-9)
        assert math.isclose(moves.sum(), sum(len(t) - 1 for t in texts), rel_tol=1e-9) and log10 >= before - 1e-9
        before = log10
        model = hidden_markov.HiddenMarkovModel.from_counts(starts, moves, emits + 1e-12, shares * 1e-9)


def brute_emissions(model, texts):
    """Expected emissions by the two unscaled recursions."""
    out = np.zeros_like(model.emit)
    for text in texts:
        forward = [model.start * model.emit[text[0]]]
        for symbol in text[1:]:
            forward.append((forward[-1] @ model.move) * model.emit[symbol])
        back = np.ones(len(model.start))
        for t in range(len(text) - 1, -1, -1):
            out[text[t]] += forward[t] * back / forward[-1].sum()
            back = model.move @ (model.emit[text[t]] * back)
    return out


def test_score_of_the_query_is_the_likelihood(spark, make):
    """On a tiny corpus: emissions times shares within classes, summed over all paths of states."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["The", "cat", "sat", "mat", "é"]) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(41, "never seen words the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("train", ~hidden_markov.held_out("doc_id", 7, 2))
    trained = hidden_markov.count(frame)
    encoded = hidden_markov.encode(frame, trained).cache()
    model, _ = hidden_markov.fit(encoded, trained)
    got = {r["doc_id"]: r["score"] for r in hidden_markov.score_texts(encoded, trained, model).collect()}
    counts = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().lower().split())
    for i, text in docs:
        total, state = 0.0, None
        for w in [*text.encode().lower().split(), None]:
            symbol = _symbol(trained, w) if w else hidden_markov.END
            if w and symbol > hidden_markov.CLASSES:  # a word with a symbol of its own, and its share
                assert math.isclose(trained.shares[symbol] / trained.shares[0], (counts[w] + 1) / (trained.n_end + 1))
            elif w:
                total += math.log10((counts[w] + 1) / trained.class_total[symbol - 1])
            emit = model.emit[symbol]
            state = (model.start if state is None else state @ model.move) * emit
        assert math.isclose(got[i], total + math.log10(state.sum()), rel_tol=1e-9)
    both = spark.createDataFrame(docs, "doc_id long, text string")
    again = {r["doc_id"]: r["score"] for r in hidden_markov.score_documents(both).collect()}
    assert again == got


def _symbol(trained, word):
    import pyarrow as pa

    pieces, endings, _ = words.words_of(pa.array([word.decode()]))
    place = trained.lexicon.find(pieces)[0]
    return int(trained.lexicon.values["symbol"][place]) if place >= 0 else 1 + int(hidden_markov.word_class(endings)[0])


def test_tables_and_batches_without_a_known_word(spark, make):
    """Blank texts only, held-out rows only, and plain texts with a blank one alone in the last batch of a partition."""
    score = QUERIES["op8_hidden_markov"]
    blank = score(spark, make(documents=[(1, None), (2, ""), (3, " \t\n")])).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in blank) == [(1, 1), (2, 1), (3, 1)] and all(r["score"] <= 0 for r in blank)
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    held = score(spark, make(documents=[(i, "words that are all unknown") for i in out])).collect()
    assert len(held) == len(out)
    for r in held:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 6, 0, 0, 0.0)
    docs = [(i, f"plain words of text {i % 50}", "en", "s", 1) for i in range(1000)] + [(1000, "", "en", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert hidden_markov.score_documents(frame).count() == 1001


def test_model_beats_words_alone(spark, make):
    rng = random.Random(9)
    kinds = [[f"{k}{c}" for c in "abcdefghij"] for k in ("red", "blue", "green")]
    docs = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(30))) for i in range(300)]
    got = [r for r in QUERIES["op8_hidden_markov"](spark, make(documents=docs)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_long_texts_alone_are_learned_from(spark):
    rng = random.Random(9)
    schema = "doc_id long, text string, train boolean"
    long = [(i, " ".join(rng.choice(["a", "b", "c"]) + str(k % 2) for k in range(hidden_markov.START_WORDS + 50)), True) for i in range(4)]
    docs = spark.createDataFrame(long, schema)
    trained = hidden_markov.count(docs)
    encoded = hidden_markov.encode(docs, trained).cache()
    model, rounds = hidden_markov.fit(encoded, trained)
    assert rounds == hidden_markov.ROUNDS
    texts = [np.frombuffer(r[0], np.uint16) for r in encoded.where("symbols is not null").select("symbols").collect()]
    assert [len(t) for t in texts] == [hidden_markov.START_WORDS + 51] * 4
    start = hidden_markov.HiddenMarkovModel.first(trained.shares)
    assert model.log10(texts).sum() > start.log10(texts).sum() + 1
    none = spark.createDataFrame([], schema)
    trained = hidden_markov.count(none)
    model, rounds = hidden_markov.fit(hidden_markov.encode(none, trained), trained)
    assert np.isfinite(model.emit).all() and rounds == 0


def test_start_is_learned_from_all_neighbours_of_all_texts(spark):
    """Long, short, blank and repeated texts, over several partitions and batches, held-out rows left out."""
    rng = random.Random(10)
    kinds = [[f"{k}{c}" for c in "abcdefghij"] for k in ("red", "blue")]
    docs = [(i, " ".join(rng.choice(kinds[(i + k // 3) % 2]) for k in range(rng.randint(0, 60))), i % 7 != 2) for i in range(2500)]
    docs += [(i, None, True) for i in range(3)] + [(i, "Same text of five words", True) for i in range(400)]
    docs += [(i, " ".join(rng.choice(kinds[0]) for _ in range(hidden_markov.START_WORDS + 700)), True) for i in range(3)]
    docs += [(i, " ".join(f"seldom{rng.randint(0, 900)}" for _ in range(40)), True) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, train boolean").repartition(3)
    trained = hidden_markov.count(frame)
    encoded = hidden_markov.encode(frame, trained).cache()
    got = hidden_markov.neighbours(encoded.where("train"), trained.places)
    symbols = [np.frombuffer(r[0], np.uint16).tolist() for r in encoded.where("train and symbols is not null").select("symbols").collect()]
    counts = Counter(pair for s in symbols for pair in zip([hidden_markov.END, *s], s))
    brute = np.zeros((hidden_markov.PLACES, hidden_markov.PLACES))
    for (x, y), n in counts.items():
        brute[trained.places[x], trained.places[y]] += n
    assert (got == brute).all() and got.sum() == sum(len(s) for s in symbols) == trained.n
    assert 0 <= trained.places.min() and trained.places.max() < hidden_markov.PLACES and (trained.places == 0).sum() == 1
    start = hidden_markov.start_of(got, trained)
    for x in (start.start.sum(), *start.move.sum(1), *start.emit.sum(0)):
        assert math.isclose(x, 1, rel_tol=1e-9)
    texts = [np.array(s, np.uint16) for s in symbols]
    assert start.log10(texts).sum() > hidden_markov.HiddenMarkovModel.first(trained.shares).log10(texts).sum() + 1000


def test_mix_is_what_its_sql_gives(spark, make):
    rng = random.Random(11)
    docs = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "B", None, "é"]), 0) for i in range(300)] + [(1000, "big " * 4000, "en", "b", 0)]
    docs += [(i, t, "en", "odd", 0) for i, t in ODD if i is not None]
    folder = make(documents=docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES["op10_mix"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(ORACLE_SQL["op10_mix"]).fetchall(), key=str)
    taken, targets = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - target) < 1 for (_, target), n in taken.items())
    assert not targets


def test_pipeline(spark, make):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["sun", "moon", "tree", "river", "stone", "cloud", "walk", "light", "green", "field", "house", "night"]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) + str(rng.randint(0, 99)) for _ in range(60))
    clean = [(i, text(), "en", f"s{i % 3}", 0) for i in range(120)]
    toxic = [(200 + i, text() + " moron scum idiot", "en", "s1", 0) for i in range(40)]
    junk = [(300 + i, " | ".join(["x#%"] * 40 + text().split()), "en", "s2", 0) for i in range(20)]
    copies = [(400 + i, clean[i][1] + " more", "en", "s0", 0) for i in range(30)]
    labels = [(d[0], 1, 0) for d in clean] + [(d[0], 1, 1) for d in toxic] + [(d[0], 0, 0) for d in junk]
    folder = make(documents=clean + toxic + junk + copies, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    from photolith.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
    assert seen["toxicity"] == {d[0] for d in clean + junk + copies}
    assert seen["quality"] == {d[0] for d in clean + copies}
    assert seen["near-duplicates"] == {d[0] for d in clean}
    assert seen["mix"] <= seen["near-duplicates"]
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() == docs.count()


def groups(texts):
    """Positions by connected component of brute-force links; a text without words is alone."""
    sets, left, found = [shingles(t) for t in texts], set(range(len(texts))), []
    while left:
        todo = [left.pop()]
        own = []
        while todo:
            own.append(k := todo.pop())
            near = {j for j in left if sets[k] & sets[j] and 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j])}
            left -= near
            todo += near
        found.append(own)
    return found


def test_pipeline_stages_on_odd_rows(spark, make, tmp_path):
    """Each stage against plain Python on what it was given: nulls, ties, repeated rows and ids, long texts, other columns."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece
    from pyspark.sql import functions as F

    rng = random.Random(21)
    words = ["sun", "moon", "tree", "river", "stone", "cloud", "walk", "light", "green", "field", "house", "night"]
    text = lambda n=60: " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) + str(rng.randint(0, 999)) for _ in range(n))
    clean = [(i, text(), "en", f"s{i % 3}", 0) for i in range(100)]
    toxic = [(200 + i, text() + " moron scum idiot", "en", "s1", 0) for i in range(40)]
    a, b, c, d = text(), text(), text(), text()
    odd = [
        (500, a, None, None, None), (500, a, None, None, None), (None, b, "en", "s0", 1), (None, b, "en", "s0", 1), (501, b + " more", "en", None, 1),
        (502, c, "en", "s2", 1), (502, d, "en", "s2", 1), (503, text(30_000), "en", "", 1), (504, clean[3][1], "en", "s9", 1), (-5, clean[3][1] + " x", "en", "s9", 1),
    ] + [(i, t, "en", "s", 0) for i, t in ODD]
    labels = [(r[0], 1, 0) for r in clean] + [(r[0], 1, 1) for r in toxic] + [(500, None, None), (None, 0, 1)]
    folder = make(documents=clean + toxic + odd, labels=labels)
    read = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    more = lambda df: df.select("*", *[F.lit("clash").alias(x) for x in ("key", "score", "kept", "toxic", "size", "taken", "n")])
    stages = dict(corpus_pipeline.STAGES)

    def step(name, rows):
        path = f"{tmp_path}/{name}"
        os.makedirs(path)
        os.symlink(f"{folder}/labels.parquet", f"{path}/labels.parquet")
        more(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents.parquet")
        return path, read(stages[name](spark, spark.read.parquet(f"{path}/documents.parquet"), path))

    given = clean + toxic + odd
    path, kept = step("toxicity", given)
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert Counter(kept) == Counter(r for r in given if pairwise_score(model, r[1]) < 0.5)
    assert {r[0] for r in kept} & {r[0] for r in toxic} == set() and set(clean) <= set(kept)
    given = kept
    path, kept = step("quality", given)
    judged = [r["doc_id"] for r in QUERIES["op2_quality"](spark, path).where("kept").collect()]
    assert Counter(r[0] for r in kept) == Counter(judged) and Counter(kept) <= Counter(given) and len({500, 503, None} & {r[0] for r in kept}) == 3
    given = kept
    _, kept = step("near-duplicates", given)
    first = lambda own: min((given[k] for k in own), key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(kept) == Counter(first(own) for own in groups([r[1] for r in given]))
    given = kept
    path, kept = step("mix", given)
    size = lambda t: len((t or "").encode().split())
    want = Counter()
    for r in QUERIES["op10_mix"](spark, path).collect():
        whole, rest = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        want.update([(r["doc_id"], r["size"])] * whole + [(r["doc_id"], rest)] * (rest > 0))
    assert Counter((r[0], size(r[1])) for r in kept) == want and len(kept) > len(given)
    assert all(any(r[1] == g[1] or g[0] == r[0] and g[1].startswith(r[1]) and r[4] == len(r[1]) for g in given) for r in kept)
    digests = stages["encode"](spark, spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long"), folder)
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = []
    for r in kept:
        ids = library.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids)))))
    assert Counter(tuple(r) for r in digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == Counter(want)


def test_pipeline_of_empty_tables(spark, make):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, make()).count() == 0


def test_first_of_each_keeps_one_row_of_a_group(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "q r s t u v w"), (3, "q r s t u v w"), (3, "other words entirely here now"), (4, ""), (4, None), (None, "no id at all here")]
    got = shingle_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], *rows[5:]], key=str)


def test_first_of_each_tells_rows_of_one_id_apart(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "other words entirely here now ok"
    first = lambda rows: sorted(map(tuple, shingle_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert first([(1, a), (3, a), (3, b), (7, b), (3, "")]) == sorted([(1, a), (3, b), (3, "")], key=str)
    assert first([(None, a), (None, a), (None, b), (5, b), (None, c), (None, None)]) == sorted([(None, a), (5, b), (None, c), (None, None)], key=str)
