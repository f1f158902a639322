"""Fingerprints, quality statistics, toxicity, HTML, WARC and token counts against brute force."""

import difflib
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from photolith.llm import fingerprints, html_text, quality, toxicity, warc
from photolith.llm.queries import QUERIES
from tests.llm.conftest import ODD, pairwise_score


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_edits_and_likeness(spark, make):
    docs = [(i, f"paragraph {i} says this.\n" + " ".join(f"word{i}x{k}" for k in range(40 * (i % 4) + 1))) for i in range(40)]
    got = by_id(QUERIES["op1_fingerprints"](spark, make(documents=docs)))
    order = sorted(docs, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edited = fingerprints.edit(text, following)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.fingerprint(text) and got[i]["n_chars"] == len(text)
        assert got[i]["near_next"] == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(following))
        assert got[i]["near_edited"] > got[i]["near_next"]


def test_tree_locates_an_edit():
    a = "\n".join(f"Paragraph {k} has a few words of its own." for k in range(30))
    b = a.replace("Paragraph 17", "Section 17")
    x, y = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert fingerprints.likeness(x, x) == 1.0 and 0.95 < fingerprints.likeness(x, y) < 1.0
    sections = fingerprints.parse(x).sections
    (place,) = fingerprints.differing_paths(x, y)
    assert sum(len(s.paragraphs) for s in sections[: place[0]]) + place[1] == 17 and sum(len(s.paragraphs) for s in sections) == 30
    assert fingerprints.likeness(fingerprints.fingerprint(""), x) == 0.0 and fingerprints.fingerprint("a b") != fingerprints.fingerprint("a  b")
    assert fingerprints.differing_paths(x, x) == [] and len(fingerprints.fingerprint("").split("/")[0]) == 32


def words_in_order(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]


def test_one_word_more_changes_little_wherever_it_is():
    words = words_in_order(400)
    own = fingerprints.fingerprint(" ".join(words))
    assert len(own) < len(" ".join(words))
    for at in (0, 1, 57, 200, 399, 400):
        other = fingerprints.fingerprint(" ".join([*words[:at], "inserted", *words[at:]]))
        assert fingerprints.likeness(own, other) > 0.95
    for n in (20, 30, 45):
        few = words_in_order(n, n)
        assert fingerprints.likeness(fingerprints.fingerprint(" ".join(few)), fingerprints.fingerprint(" ".join([*few[:-1], "changed"]))) > 0.7


@pytest.mark.parametrize("n", [30, 60, 199, 201, 300, 1000])
def test_order_counts_at_every_length(n):
    words = words_in_order(n, n)
    own, turned, other = (fingerprints.fingerprint(" ".join(w)) for w in (words, words[::-1], words_in_order(n, n + 7)))
    assert fingerprints.likeness(own, turned) < 0.25 and fingerprints.likeness(own, other) < 0.2
    half = " ".join(words[: n // 2] + words_in_order(n - n // 2, n + 1))
    by_code_points = difflib.SequenceMatcher(None, words, half.split(), autojunk=False).ratio()
    assert abs(fingerprints.likeness(own, fingerprints.fingerprint(half)) - by_code_points) < 0.12


def brute_leaves(text):
    """Leaves by the definition, one character at a time: (text, ends a line)."""
    from photolith.llm.words import EXACT, hashes, mix

    out, at, words = [], 0, 0
    for match in re.finditer(r"[^\x20\x09-\x0D]+|\n", text):
        raw = np.frombuffer(match[0].encode(), np.uint8)
        even = match[0] != "\n" and int(mix(hashes(raw, np.array([0]), np.array([len(raw)]), EXACT))[0]) % 2 == 0
        words += 1
        if even or match[0] == "\n" or words == fingerprints.MOST_WORDS:
            out.append(text[at : match.end()])
            at, words = match.end(), 0
    return out + ([text[at:]] if at < len(text) else [])


def brute_tree(text):
    from photolith.llm.words import EXACT, hashes, mix

    def code(leaf):
        raw = np.frombuffer(leaf.encode(), np.uint8)
        return int(mix(hashes(raw, np.array([0]), np.array([len(raw)]), EXACT))[0])

    def digest(raw, size=8):
        return hashlib.blake2b(raw, digest_size=size).digest()

    lines, line = [], []
    for leaf in brute_leaves(text):
        line.append(leaf)
        if leaf.endswith("\n"):
            lines.append(line)
            line = []
    lines += [line] if line else []
    sections, held = [], []
    for k, line in enumerate(lines):
        held.append((digest(b"".join(code(x).to_bytes(8, "little") for x in line)), line))
        if not "".join(line).encode().split() or held[-1][0][0] % 4 == 0 or k + 1 == len(lines):
            sections.append((digest(b"".join(h[0] for h in held)), held))
            held = []
    root = digest(b"".join(s for s, _ in sections), 16).hex()
    return root, [(s[:4].hex(), [(d[:4].hex(), [((code(x) >> 46) << 40) + len(x) for x in line]) for d, line in inner]) for s, inner in sections]


@pytest.mark.parametrize("text", [t or "" for _, t in ODD] + ["one line\n\n\nanother é ß\n  \nlast", "\n", " lead\ttab \n", "x" * 70 + " y", "\n".join(f"line {k} of many" for k in range(60))])
def test_trees_are_those_of_the_definition(text):
    root, sections = brute_tree(text)
    for tree in (fingerprints.trees(["before it", text, "", "after\n"])[1], fingerprints.parse(fingerprints.fingerprint(text))):
        assert tree.root == root
        assert [(s.digest, [(p.digest, p.leaves) for p in s.paragraphs]) for s in tree.sections] == sections
        assert sum(s.weight for s in tree.sections) == len(text) == sum(p.weight for s in tree.sections for p in s.paragraphs)


def test_walk_of_differing_branches():
    """Matches rise on both sides, are equal, and are as many as can be where items are distinct."""
    rng = random.Random(4)
    for turn in range(300):
        xs, ys = ([rng.randint(0, 8 if turn % 2 else 10**6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        if turn % 2 == 0 and xs:
            ys = rng.sample(xs, len(xs)) if turn % 4 else [x for x in xs if rng.random() < 0.7]
        pairs = fingerprints.in_order(xs, ys)
        assert all(xs[i] == ys[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        longest = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        if len(set(xs)) == len(xs) and len(set(ys)) == len(ys):
            assert len(pairs) == longest[-1][-1]
        assert len(pairs) <= longest[-1][-1]


def test_equal_branches_are_shared_with_all_they_hold():
    """The walk gives what an alignment of all leaves gives, where every leaf is in the text once; only those of a line's end
    alone are all alike, which the walk keeps with their lines."""
    paragraphs = [" ".join(f"{w}{k}x{i}" for i, w in enumerate(words_in_order(12, 100 + k))) for k in range(40)]
    text, moved = "\n".join(paragraphs), "\n".join([*paragraphs[:10], "a new line here", *paragraphs[12:30], "another new line", *paragraphs[30:]])
    a, b = fingerprints.trees([text, moved])
    left, right = ([leaf for s in t.sections for p in s.paragraphs for leaf in p.leaves] for t in (a, b))
    whole = sum(leaf & (1 << 40) - 1 for leaf in (left[i] for i, _ in fingerprints.in_order(left, right)))
    shared = fingerprints.shared_weight(a, b)
    assert 0 <= shared - whole <= sum(leaf & (1 << 40) - 1 == 1 for leaf in left) < 40
    assert fingerprints.tree_likeness(a, b) == 2 * shared / (len(text) + len(moved))


def brute_repeated(words, n=8):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(n)})


def test_rule_statistics_match_brute_force(spark, make):
    random.seed(3)
    docs = [(i, " ".join(random.choice(["a", "b", "c#", "d|\n", "\n\n"]) for _ in range(random.randint(0, 60)))) for i in range(60)] + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    got = by_id(QUERIES["op2_quality"](spark, make(documents=docs)))
    for i, text in docs:
        text = text or ""
        words = text.encode().split()
        lines = [line for line in text.split("\n") if line.encode().split()]
        r = got[i]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == brute_repeated(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_path_lengths_are_those_of_the_splits():
    """A tree of all rows: each leaf's rows are counted, its level is walked, and what it lacks is the mean of a search."""
    rows = np.random.default_rng(0).normal(0, 1, (200, 3)).round(1)
    rows[150:] = rows[0]  # equal rows share a leaf, however deep
    forest = quality.IsolationForest(rows, trees=4, tree_rows=len(rows))

    def lacks(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    total = np.zeros(len(rows))
    for feature, threshold, left, depth in forest.trees:
        where = {}
        for k, row in enumerate(rows):
            node, level = 0, 0
            while feature[node] >= 0:
                node, level = left[node] + int(row[feature[node]] > threshold[node]), level + 1
            where.setdefault((node, level), []).append(k)
        for (node, level), inside in where.items():
            assert np.isclose(depth[node], level + lacks(len(inside)))
            total[inside] += level + lacks(len(inside))
    assert np.allclose(forest.score(rows), 2 ** (-total / 4 / lacks(len(rows))))
    outlier = np.vstack([rows, [[9, 9, 9]]])
    scores = quality.IsolationForest(outlier).score(outlier)
    assert scores[-1] == scores.max() and 0 < scores.min() and scores.max() <= 1


def brute_threshold(found):
    """From (bin, label) of labelled rows: the bin that finds most bad rows less good ones, of those that lose few good ones."""
    bad, good = (sum(y == label for _, y in found) for label in (0, 1))
    best, gain = None, 0.0
    for at in range(quality.BINS + 1):
        lost, caught = (sum(b >= at and y == label for b, y in found) / n for label, n in ((1, good), (0, bad))) if bad and good else (1, 0)
        if lost <= quality.LOSS and caught - lost > gain:
            best, gain = at, caught - lost
    return best


def test_kept_follows_the_threshold_of_the_labels(spark, make):
    rng = random.Random(6)
    plain = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(25, 60)))
    junk = lambda: " ".join(rng.choice(["#", "$$", "a", "|x|", "!!", "b?"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(25, 60)))
    docs = [(i, junk() if i % 5 == 0 else plain()) for i in range(250)] + [(300, None), (301, "too short"), (302, "again " * 40)]
    labels = [(i, int(i % 5 != 0 or i % 35 == 0), 0) for i in range(0, 250, 2)] + [(300, 0, 0), (1, None, 0), (3, 7, 0)]
    got = by_id(QUERIES["op2_quality"](spark, make(documents=docs, labels=labels)))
    assert [got[i]["base_failed"] for i in (300, 301, 302)] == [True] * 3
    judged = [(int(np.floor(got[i]["anomaly"] * quality.BINS)), y) for i, y, _ in labels if y in (0, 1) and not got[i]["base_failed"]]
    at = brute_threshold(judged)
    assert at is not None
    for r in got.values():
        assert r["kept"] == (not r["base_failed"] and np.floor(r["anomaly"] * quality.BINS) < at)
    assert sum(not got[i]["kept"] for i in range(0, 250, 5)) > 5 and sum(not got[i]["kept"] for i in range(250) if i % 5) <= 5
    assert quality.best_threshold([(400, 1, 100), (700, 0, 10), (710, 1, 0)]) == 0.401 and quality.best_threshold([(400, 1, 10)]) == 2.0
    assert quality.best_threshold([(400, 1, 100), (700, 0, 10)]) == brute_threshold([(400, 1)] * 100 + [(700, 0)] * 10) / quality.BINS


def test_machine_learns_a_pair():
    """Neither term alone is toxic; both together are: no additive weights can do that as well."""
    random.seed(1)
    rows, labels = [], []
    for _ in range(600):
        words = {random.choice(["insult", "other"]), random.choice(["group", "thing"]), f"w{random.randint(0, 30)}"}
        rows.append(toxicity.terms(" ".join(words)))
        labels.append(float({"insult", "group"} <= words))
    y = np.array(labels)
    model = toxicity.FactorizationMachine.fit(rows, y, np.ones(len(y)))
    low = [model.score([t])[0] for t in ("insult thing", "other group", "other thing", "")]
    assert model.score(["insult group"])[0] > 0.5 > max(low)


def test_scores_are_sums_over_pairs():
    random.seed(2)
    words = ["insult", "insulting", "group", "groups", "thing", *[f"{a}{b}word" for a in "abcdef" for b in "uvwxyz"]]
    texts = [" ".join(random.choices(words, k=random.randint(0, 12))) for _ in range(500)]
    y = np.array([float("insult" in t and "group" in t or "auword" in t) for t in texts])
    model = toxicity.FactorizationMachine.fit([toxicity.terms(t) for t in texts], y, np.ones(len(y)))
    assert len(model.weights) > 2
    for t, score in zip(texts, model.score(texts), strict=True):
        assert score == pytest.approx(pairwise_score(model, t), rel=1e-9)


def test_toxic_documents_are_found_and_labels_of_the_fold_unread(spark, make):
    random.seed(5)
    docs = [(i, " ".join(random.choice(["fine", "good", "day", "sun"]) for _ in range(30)) + (" scumbag moron" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    folder = make(documents=docs, labels=labels)
    got = by_id(QUERIES["op3_toxicity"](spark, folder))
    held = [i for i in got if got[i]["held_out"]]
    assert 40 < len(held) < 120 and all(got[i]["predicted"] == int(i % 4 == 0) for i in got)
    turned = [(i, q, 1 - t if got[i]["held_out"] else t) for i, q, t in labels]
    again = by_id(QUERIES["op3_toxicity"](spark, make(documents=docs, labels=turned)))
    assert again == got


PAGE = (
    "<html><head><title>T</title><script>if(a<b){'</p>'}</script></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"
    "<div class='ad'>Buy this thing now it is cheap</div><article><h1>The  title</h1><p><b>One &amp; two&nbsp;three<br>four.<p>Short.</p>"
    "<div id=comments><p>I liked this very much</p></div></article><footer>&copy; us</footer>"
)


def test_main_text():
    assert html_text.main_text(PAGE) == "The title\n\nOne & two three four.\n\nShort."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "" and html_text.main_text("<script>x") == ""
    long = "word " * 40
    plain = f"<div><a href=a>one</a> <a href=b>two</a></div><h2>Heading</h2><p>{long}</p><p>{long}</p><div><a href=c>more</a></div>"
    assert html_text.main_text(plain) == "\n\n".join([long.strip()] * 2)


def test_no_article_is_lost_to_a_head_or_a_wrapper():
    body = "word " * 40
    text = body.strip()
    for page in (
        f"<html><head><title>T</title><meta name=a><body><article><p>{body}</p></article></body></html>",
        f"<head><title>T</title><p>{body}</p><p>{body}</p>",
        f"<head><style>x</style>{body}<p>{body}</p>",
        f"<body><div class='content with-sidebar'><article><p>{body}</p></article></div></body>",
        f"<main><div id='page-header-layout'><p>{body}</p></div></main>",
        f"<div class='header'><main><p>{body}</p></main></div>",
        f"<div class='with-sidebar'><article><p>{body}</p></article><div class=sidebar><p>{'more ' * 9}</p></div></div><div class=notes><p>{'x ' * 90}</p></div>",
    ):
        assert text in html_text.main_text(page) and "T" not in html_text.main_text(page) and "more" not in html_text.main_text(page)
    comments = f"<article><p>{body}</p></article><div id=comments><p>{'liked ' * 90}</p></div>"
    assert html_text.main_text(comments) == text
    beside = f"<article><p>{body}</p></article><div class=sidebar><article><p>{'side ' * 12}</p></article></div>"
    assert html_text.main_text(beside) == text


def test_markup_as_browsers_read_it():
    body = ("word " * 40).strip()
    for page in (
        f"<script>for(i=0;i<n;i++){{}} // don't</script><article><p>{body} it's</p></article>",
        f"<article><p><a title=don't href=x></a>{body} it's</p></article>",
        f"<article><img alt='a > b'><p>{body} it's</p><script>x='<!--'</script></article>",
        f"<body><form action=x><div><p>{body} it's</p></div><input></form></body>",
        f"<div class='content with-sidebar'><p>{body} it's</p></div>",
        f"<!-- <p>no</p> --><style>p>a{{}}</STYLE ><p>{body} it's</p>",
    ):
        assert html_text.main_text(page) == body + " it's", page
    three = ["One short paragraph here now.", "Another short one follows it.", "And the third one ends it."]
    assert html_text.main_text("<div>" + "".join(f"<p>{t}</p>" for t in three) + "</div>") == "\n\n".join(three)
    assert html_text.main_text("<p>A single paragraph of only eight words here.</p>") == "A single paragraph of only eight words here."


@pytest.mark.parametrize("times", [0.1, 0.9, 1.1, 2, 5])
@pytest.mark.parametrize("name", ["comments", "comment-list", "postComments", "cookie-notice", "sidebar left", "site-footer", "ad"])
def test_what_names_itself_beside_the_text_is_out_at_any_length(times, name):
    body, other = "word " * 40, "liked " * int(40 * times)
    for page in (
        f"<article><h1>Title here</h1><p>{body}</p><div class='{name}'><p>{other}</p></div></article>",
        f"<article><h1>Title here</h1><p>{body}</p></article><section id={name.split()[0]}><p>{other}</p><p>More.</p></section>",
        f"<ul class='{name}'><li>{other}</ul><main><h1>Title here</h1><p>{body}</p></main>",
    ):
        assert html_text.main_text(page) == "Title here\n\n" + body.strip()
    form = f"<form><p>{body}</p><div class='{name}'><p>{other}</p></div></form>"
    assert html_text.main_text(form) == body.strip()


def test_names_that_only_look_like_one():
    body = ("word " * 30).strip()
    for inner in (
        f"<section id='related-work'><p>{body}</p></section>", f"<p id='other-side-of-town'>{body}</p>", f"<p id=comments>{body}</p>", f"<div class='shared-history'><p>{body}</p></div>",
        f"<div class='searching'><p>{body}</p></div>", f"<p><span class=ad>{body}</span></p>", f"<h2 id=notice>{body}</h2>", f"<div class='tags-of-war'><p>{body}</p></div>",
    ):
        assert html_text.main_text(f"<article><p>Begin.</p>{inner}<p>End.</p></article>") == f"Begin.\n\n{body}\n\nEnd."
    assert html_text.main_text(f"<article><p>{body}</p><p class='ad'>Buy now.</p></article>") == body


def test_tree_against_brute_force_and_without_marks():
    """The tree's first split is the best of all splits; pages stripped of names and of semantic tags are mostly told right."""
    rows, labels = [r[:-1] for r in html_text.LABELLED], [r[-1] for r in html_text.LABELLED]

    def impurity(f, at):
        sides = [[y for r, y in zip(rows, labels, strict=True) if (r[f] > at) == side] for side in (False, True)]
        return sum(len(ys) * (sum(ys) / len(ys)) * (1 - sum(ys) / len(ys)) for ys in sides if ys)

    tree = html_text.DecisionTree(rows, labels)
    values = [sorted({r[f] for r in rows}) for f in range(8)]
    best = min(impurity(f, (a + b) / 2) for f in range(8) for a, b in zip(values[f], values[f][1:], strict=False))
    assert np.isclose(impurity(*tree.split[:2]), best)
    right = total = 0
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        bare = re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section)[^>]*>", r"<\1div>", re.sub(r" (class|id|role)=\"[^\"]*\"", "", html))
        told = [[tree.predict(r) for r in html_text.features(html_text.blocks(h))] for h in (html, bare)]
        right += sum(x == y for x, y in zip(*told, strict=True))
        total += len(told[0])
    assert right > 0.95 * total


def test_pages(spark, make):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)]
    got = sorted(map(tuple, QUERIES["op4_html_text"](spark, make(pages=pages)).collect()), key=str)
    text = html_text.main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0)], key=str)


def test_warc_round_trip_and_roles(spark, make, tmp_path):
    big, small = "é\r\n\r\nWARC/1.1 " + "x" * 1200, "tiny"
    pages = [(1, "u1", big), (2, "u2", big), (7, "u7", big), (3, "u3", small), (4, "u4", small), (5, None, None), (6, "u6", "y" * 999 + "é")]
    folder = make(pages=pages)
    got = by_id(QUERIES["op5_warc"](spark, folder), "page_id")
    assert len(got) == 7 and [i for i, r in got.items() if r["record_type"] == "revisit"] == [i for i in got if i in (1, 2)]
    assert {got[1]["refers_to"], got[2]["refers_to"]} == {7} and got[5]["payload_bytes"] == 0
    for i, _, body in pages:
        raw = (body or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    path = "file://" + str(tmp_path / "archive")
    warc.write_warc(spark.read.parquet(f"{folder}/pages.parquet"), path)
    found = warc.read_warc(spark, path)
    assert {r["page_id"]: r["payload"] for r in found.where("record_type = 'response'").collect()} == {i: b or "" for i, _, b in pages if i not in (1, 2)}
    pushed = found.where("record_type = 'response' and payload_bytes >= 1000")
    assert sorted(r["page_id"] for r in pushed.collect()) == [6, 7]


def test_pushed_predicates_skip_payloads():
    reader = warc.WarcReader({"files": "[]"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), "x")]))
    assert [f.attribute for f in left] == [("payload",)] and len(reader.tests) == 1
    assert reader.passes({"record_type": "response"}) and not reader.passes({"record_type": "revisit"})


@pytest.mark.parametrize("text", [t or "" for _, t in ODD] + [PAGE])
def test_token_counts_and_pieces_are_the_libraries(text):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from photolith.llm import piece_codec, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, special = Tokenizer.from_file(path), token_counts.special_string(path)
    counted = text.count(special) + sum(len(library.encode(p, add_special_tokens=False).ids) for p in token_counts.pre_tokens(text, special))
    assert counted == len(library.encode(text, add_special_tokens=False).ids)
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = SentencePieceProcessor(model_file=path)
    model = piece_codec.piece_model(path)
    ids = piece_codec.encode_text(model, text)
    assert ids == pieces.encode(text, add_eos=True)
    decoded = "".join(model.decode_cut(model.encode_cut(c)) for c in piece_codec.cuts(text))[1:]
    assert decoded == pieces.decode(ids)


def test_cuts_encoded_at_once_are_the_librarys(monkeypatch):
    """Short, long and odd cuts, in any number at once, with few places for pairs, and again from the cuts held."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from photolith.llm import piece_codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), piece_codec.PieceModel(path)
    rng = random.Random(12)
    letters = ["th", "er", "in", "e", "a", "S", "\u00e9", "\U0001f600", "\u4e2d", ".", "9", "\u2581", "\x00", " ", "  "]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 9, 38, 41, 90)))) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    texts += ["", " ", None, *texts[:50]]
    short = [cut for text in texts for cut in piece_codec.cuts(text or "")]
    assert any(len(c) > piece_codec.SHORT for c in short) and any(len(c) == 1 for c in short)
    for at_once, places, held in ((10_000, 1_048_573, 80_000), (7, 11, 4)):
        for name, value in (("AT_ONCE", at_once), ("PAIR_PLACES", places), ("HELD", held), ("LOOKED_UP", at_once)):
            monkeypatch.setattr(piece_codec, name, value)
        model = piece_codec.PieceModel(path)
        assert model.encode_cuts(short) == [model.encode_cut(c) for c in short]
        cache = piece_codec._Cuts(model)
        got = [made for group in piece_codec._grouped(texts) for made in cache.of(group)]
        for text, made in zip(texts, got, strict=True):
            ids = library.encode(text or "")
            assert " ".join(x[0] for x in made) == " ".join(map(str, ids))
            assert "".join(x[1] for x in made)[1:] == library.decode(ids)


def test_token_queries_give_the_libraries_results(spark, make):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    folder = make(documents=[(i, t) for i, (_, t) in enumerate(ODD)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens, codes = by_id(QUERIES["op6_token_counts"](spark, folder)), by_id(QUERIES["op9_pieces"](spark, folder))
    for i, (_, text) in enumerate(ODD):
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tokens[i] == {"doc_id": i, "n_bytes": len(text.encode()), "n_tokens": n, "over_limit": n > 1024}
        ids = pieces.encode(text, add_eos=True)
        assert codes[i]["n_tokens"] == len(ids) and codes[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert codes[i]["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
