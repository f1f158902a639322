"""SimHash, spelling variants and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from photolith.llm import alignment, simhash, spelling
from photolith.llm.queries import QUERIES
from tests.llm.conftest import ODD


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    found = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_classes(prints):
    """Each print's component by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in known}


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_simhash_finds_all_components(spark, make):
    rng = random.Random(4)
    texts = []
    for b in range(60):
        base = " ".join(f"B{b}w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 400)))
        texts += [edited(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 8))]
    docs = [(i, t) for i, t in enumerate(texts + texts[:40])] + [(1000 + (i or 0), t) for i, t in ODD]
    docs += [(None, "no id"), (None, texts[0])]
    got = QUERIES["op11_simhash"](spark, make(documents=docs)).collect()
    prints = [brute_fingerprint(t) for _, t in docs]
    of, smallest = brute_classes(prints), {}
    for (i, _), p in zip(docs, prints, strict=True):
        if i is not None:
            smallest[of[p]] = min(i, smallest.get(of[p], i))
    want = [(i, f"{p:016x}", smallest.get(of[p])) for (i, _), p in zip(docs, prints, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(set(smallest)) < len(set(prints))


@pytest.mark.parametrize("cold", [2, 8, 10_000])
def test_hot_buckets_lose_no_component(spark, cold):
    """Clouds of fingerprints around centres, with chains between them, at any limit for a cold bucket."""
    rng = random.Random(cold)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(80):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
        chain = centre
        for _ in range(10):
            chain ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fingerprint long"), cold=cold).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    want, got = brute_classes(prints), {p: find(p) for p in prints}
    assert len(set(got.values())) == len(set(want.values())) == len({(want[p], got[p]) for p in prints})


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_fewer_bits_are_linked_too(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(62)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 4))) for _ in range(120)}
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {tuple(r) for r in simhash.by_midpoints(frame, bits).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits}


def test_blocks_of_fingerprints():
    for n in (1, 10**5, 10**7, 10**9, 10**11):
        blocks = simhash.blocks_for(n)
        assert n / 2 ** (64 * (blocks - 4) // blocks) <= simhash.EVEN
    rng = random.Random(1)
    for blocks in (6, 7, 9):
        masks = simhash.block_masks(blocks)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variant_docs(seed):
    rng = random.Random(seed)
    letters = "abcdefghé÷ÿZ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(25)]
    docs = []
    for i in range(400):
        picked = []
        for _ in range(40):
            w = words[min(int(rng.expovariate(0.3)), 24)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[at]]) + w[at + 1 :]
            picked.append(w)
        docs.append((i, " ".join(picked)))
    chain = "chainedword " * 600 + "chainedwerd " * 40 + "chainedwert " * 3
    docs.append((9, chain))
    return docs + [(None, docs[0][1]), (None, None), (7, "")]


def test_spelling_variants(spark, make):
    docs = variant_docs(5) + [(500 + k, t) for k, (_, t) in enumerate(ODD)]
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES["op12_spelling"](spark, make(documents=docs)).collect())
    want = brute_variants(docs)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


@pytest.mark.parametrize(("symbols", "hot"), [(2, 3), (2, 1), (5, 2), (8, 1)])
def test_hot_reduced_words_lose_no_pair(spark, symbols, hot):
    words = spelling.vocabulary(spark.createDataFrame(variant_docs(6), "doc_id long, text string")).cache()
    known = {r["word"]: r["n"] for r in words.collect()}
    got = [tuple(r) for r in spelling.near_words(words, symbols, hot).collect()]
    assert sorted(got) == sorted((a, b, known[b]) for a in known for b in known if one_apart(a, b))


def test_neighbourhoods_are_full_and_distinct():
    rng = random.Random(3)
    for _ in range(40):
        symbols = rng.choice([2, 3, 5, 12])
        word = "".join(chr(rng.randint(97, 122)) for _ in range(rng.randint(1, 9)))
        r = tuple(ord(c) % symbols for c in word)
        want = {r} | {r[:i] + r[i + 1 :] for i in range(len(r))} | {r[:i] + (c,) + r[i + 1 :] for i in range(len(r)) for c in range(symbols)}
        want |= {r[:i] + (c,) + r[i:] for i in range(len(r) + 1) for c in range(symbols)}
        hashes = np.concatenate([h for _, h in spelling.neighbourhoods([word], symbols)]).tolist()
        assert len(hashes) == len(set(hashes)) == len(want)
        assert set(spelling.reduced(["".join(chr(symbols * 10 + c) for c in x) for x in want if x], symbols).tolist()) <= set(hashes)


def test_long_words_are_taken_in_parts(monkeypatch):
    words = ["ab" * 3000, "abc" * 5]
    whole = sorted(np.concatenate([h for _, h in spelling.neighbourhoods(words, 4)]).tolist())
    monkeypatch.setattr(spelling, "CELLS", 500)
    assert sorted(np.concatenate([h for _, h in spelling.neighbourhoods(words, 4)]).tolist()) == whole


def sides(byte_path, piece_path):
    a, b = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            return [], []
        return [list(zip(ids, np.cumsum([0, *map(len, raw)]).tolist(), np.cumsum([len(r) for r in raw]).tolist())) for ids, raw in ((ids_a, raw_a), (ids_b, raw_b))]

    return tokens


def brute_alignment(docs, byte_path, piece_path):
    tokens, found, counts = sides(byte_path, piece_path), [], Counter()
    for i, text in docs:
        a, b = tokens(text or "")
        links, k = [], 0
        for x, start, end in a:
            while k < len(b) and b[k][2] <= start:
                k += 1
            at = k
            while at < len(b) and b[at][1] < end:
                links.append((x, b[at][0]))
                at += 1
        groups, low = [], 0
        for end in sorted({t[2] for t in a} & {t[2] for t in b}):
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= end) for side in (a, b)) if len(a) < 500 else None)
            low = end
        counts.update(links)
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((i, len(a), len(b), len(groups), links, digest))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    return [(i, na, nb, g, len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), d) for i, na, nb, g, ls, d in found]


STRANGE = [
    "Hello wörld, don't  do\n\n  it  \n x\t y ", "▁x", "a<|endoftext|>b </s> <s> <unk>", "  lead", "trail  ", "\n a", " ", "   ", "\n", "a \n \n  b  c　   d   e",
    "日本語 テキスト \U0001f600", "é ﬁ ½", "x" * 700 + " " + "yz" * 600, "\x00 \x1c \x85", "12345 6,789.00 $#@!", "we'll I'm they've", "tab\tend\t", "a▁ b",
]


def test_alignment_of_documents(spark, make):
    rng = random.Random(8)
    some = ["the", "Tokens", "naïve", "über-", "don't", "...", "123", "\n", "<s>", "  ", "東京", "qzxv"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, t) for k, t in enumerate(STRANGE)] + [((i or 0) + 200, t) for i, t in ODD] + [(None, "no id"), (3, docs[3][1])]
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES["op13_alignment"](spark, make(documents=docs)).collect()), key=str)
    want = sorted(brute_alignment(docs, *paths), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7])
    assert sum(w[1] == 0 for w in want) >= 4


def test_rare_pairs_are_joined(spark, monkeypatch):
    """With next to nothing broadcast the sums come by the join, and stay the same."""
    docs = spark.createDataFrame([(i, f"some words {i} and don't {i % 3}") for i in range(50)], "doc_id long, text string")
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    whole = sorted(map(tuple, alignment.align(docs, *paths).collect()))
    monkeypatch.setattr(alignment, "most_frequent", lambda counts, columns: _few(counts, columns))
    assert sorted(map(tuple, alignment.align(docs, *paths).collect())) == whole


def _few(counts, columns):
    return counts.where(F.col("n") > 120).select(*columns).toArrow()


def test_vocabulary_order_is_checked():
    pair = alignment.tokenizer_pair(*[public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")])
    texts = [t for t in STRANGE if "▁" not in t]
    fast = pair.encode(texts)
    slow = alignment.Pair(*[public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")])
    assert pair.fast is not None
    slow.fast = None
    assert slow.encode(texts) == fast
