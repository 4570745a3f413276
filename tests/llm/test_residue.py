from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import residue as r

HUNK = "\ndiff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-old\n+new\n"
GIT = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A B <a@b.example>\nDate:   2014-05-21 03:26:36\n\n    "
MAIL = "From 0123456789abcdef0123456789abcdef01234567 2013-11-13 22:05:03\nFrom: A B <a@b.example>\nSubject: [PATCH 2/3] "
SVN = "------------------------------------------------------------\nr44721 | ab | 2013-06-23 01:05:00 | 1 lines\n\n"

RESIDUE = {
    GIT + "${TICKET}: {{ summary }}\n" + HUNK: r.PLACEHOLDER,
    MAIL + "Update <YOUR REASON>\n\nThe reader kept a stale copy; the message names the table.\n---\n" + HUNK: r.PLACEHOLDER,
    SVN + "[@ticket@] adjust %(module)s settings\n" + HUNK: r.PLACEHOLDER,
    "## What does this change do?\n\n## Why?\n\n- [ ] tests added\n" + HUNK: r.FORM,
    GIT + "# Write a message above.\n#\n# Lines with a hash are dropped.\n" + HUNK: r.FORM,
    MAIL + "Subject of at most 72 characters\n\nDetails go here. Explain why, not how.\n\nBug: n/a\n---\n" + HUNK: r.FORM,
    GIT + "Type your message here\n\nReplace this section with what the change does.\n" + HUNK: r.FORM,
    SVN + "Commit message goes here\n" + HUNK: r.FORM,
    MAIL + "Lorem ipsum dolor velit nullam undique\ntotem amur.\n--\n1.1\n": r.FILLER,
    "asdf asdf asdf asdf" + HUNK: r.FILLER,
    "qwer asdf zxcv" + HUNK: r.FILLER,
    "....... ......" + HUNK: r.FILLER,
    "Sample copy. Sample copy. Real words later." + HUNK: r.FILLER,
    "<html><head><title>X</title></head>\n<body><h1>Error 502</h1>\n<p>The archive ran out of memory.</p></body></html>": r.ERROR,
    GIT + "Fix the reader\n\n    503 | The service is overloaded right now.\n": r.ERROR,
    "SEITE NICHT GEFUNDEN (404). BITTE PRÜFEN SIE DIE ADRESSE.": r.ERROR,
    SVN + "History\n\nYou need to enable JavaScript to use this application.\n": r.SCRIPT,
    "<!doctype html><title>v</title><noscript>Turn scripts on.</noscript>": r.SCRIPT,
}
CONTENT = [
    GIT + "Expand ${TICKET} in the release script instead of failing\n" + HUNK,
    MAIL + 'Reject commits whose message still says "<reason>"\n---\n' + HUNK,
    SVN + "Escape `{{ ticket }}` in the mail template\n" + HUNK,
    GIT + "Drop lorem ipsum from the demo fixture\n" + HUNK,
    GIT + "Show a proper 404 page when the loader fails\n\n    Log \"page not found\" only once.\n" + HUNK,
    GIT + "Tell visitors without JavaScript what to do\n" + HUNK,
    GIT + "Fix layout\n" + HUNK + "+<noscript>JavaScript is required here.</noscript>\n+lorem ipsum dolor\n+${TICKET}\n",
    GIT + "\n" + HUNK, "fix" + HUNK, "." + HUNK, "wip" + HUNK, "Update icons" + HUNK,
    GIT + "Merge branch 'fix/not-found' into main\n\n    * fix/not-found:\n      Fix page not found\n",
    MAIL + "Release notes 6.32\n\n- remove retry on timed out requests\n--\n2.0\n",
    MAIL + "Bump zulib from 4.4.4 to 8.5.8\n\n- notes: https://z.example/notes\n---\n" + HUNK,
    GIT + "Keep subjects under 72 characters\n\nThe log view cut longer ones off.\n" + HUNK, GIT + "Say what and why a hook failed\n\nThe loader told neither.\n\nBug: n/a\n" + HUNK,
    GIT + "Split the form\n\nTwo threads shared one open cursor; the table is named.\n\nTwo threads shared one open cursor; the table is named.\n" + HUNK,
    GIT + "Drop lorem ipsum fixture\n" + HUNK, GIT + "Handle timed out sockets in the pool\n", GIT + "Enable scripts in CI\n", "Log forbidden requests once",
    "", None,
]


def test_residue(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate([*RESIDUE, *CONTENT])]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, node string, kind string, hash int").repartition(3)
    found = {x["doc_id"]: x["kind"] for x in r.residue(docs).collect()}
    assert found == {i: kind for i, kind in enumerate(RESIDUE.values())}
    kept = r.without_residue(docs)
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(len(RESIDUE), len(rows))) and kept.columns == docs.columns


def near(a, b):
    close = bin((r.simhash(a) ^ r.simhash(b)) & (2**64 - 1)).count("1") <= r.MAX_DISTANCE
    return close and r.similarity(" ".join(a), " ".join(b)) >= r.SIMILARITY


def test_labels_are_passed_on(spark):
    """Near-duplicates of residue become residue through chains, in the same standing (with or without hunks)."""
    rng = np.random.default_rng(2)
    first = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in rng.integers(0, 600, 300)]
    first[150:153] = ["not", "found", "here"]

    def changed(words, keep_away=None):
        while True:
            other = [*words]
            at = int(rng.integers(5, 140)) + 150 * int(rng.integers(0, 2))
            other[at] = "novel"
            other[150:153] = ["moved", "over", "there"]
            if near(words, other) and (keep_away is None or not near(keep_away, other)):
                return other

    second = changed(first)
    third = changed(second, first)
    texts = [" ".join(x) for x in (first, second, third)]
    texts += [texts[1] + HUNK, texts[1].replace("moved", "moved, 17,"), " ".join(reversed(second))]
    found = {x["doc_id"] for x in r.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert r.judge(texts[1], True) is None and found == {0, 1, 2, 4}


def test_residue_below_a_merge_subject_and_of_equal_words(spark):
    merge = GIT + "Merge branch 'fix/x' into main\n\n"
    page, notice = "503 | The service is overloaded right now.\n", "You need to enable JavaScript to use this application.\n"
    texts = [merge + page, merge + notice, merge + "<html><body>Error 502</body></html>\n", "The page is not found. Bye now.", "The page is not-found. Bye now."]
    sentence = {text: size for text, size in r.sentences(page)}
    assert sentence == {"the service is overloaded right now": 6}
    content = [merge + "* fix/x:\nFix page not found. Bye\n", merge + "Fix page not found\n", merge + page + HUNK, merge, GIT + "Merge pull request #3 from a/page-not-found\n", "Release notes 6.32\n\n- stop retry. Requests timed out.\n"]
    rows = list(enumerate([*texts, *content]))
    assert r.judge(texts[4], True) is None
    assert {x["doc_id"] for x in r.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(len(texts)))


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node string, words string, hash long, kind string").withColumn("hunks", F.lit(False))


@pytest.mark.parametrize("first_wave", [64, 1])
def test_tables_lose_no_pair(spark, first_wave, monkeypatch):
    """All pairs within the distance and the similarity are linked, by comparison with all pairs."""
    monkeypatch.setattr(r, "FIRST_WAVE", first_wave)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 12)]
    rows = []
    for i, h in enumerate(base):
        for j in range(6):
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                h ^= 1 << int(bit)
            signed = (h + 2**63) % 2**64 - 2**63
            rows.append((f"{i}-{j}", "a b c d e f g h i j k" if j % 2 else "a b c d e f g h i j z", signed, "error page" if j in (0, 3) else None))
    data = nodes(spark, rows)
    found = {x["node"] for x in r.near_labelled(data.where(F.col("kind").isNull()).drop("kind"), data.where(F.col("kind").isNotNull())).collect()}
    close = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert found == {b[0] for a in rows if a[3] for b in rows if not b[3] and close(a[2], b[2]) and r.similarity(a[1], b[1]) >= 0.8} and found


def reworded(rng, words, n):
    other = [*words]
    for at in rng.choice(len(words), n, replace=False):
        other[int(at)] = f"novel{'abcdefghij'[int(at) % 10]}"
    return other


@pytest.mark.parametrize("first_wave", [64, 1])
def test_similar_nodes_far_apart_in_simhash(spark, first_wave, monkeypatch):
    """All pairs within the similarity are linked, whatever their distance, by comparison with all pairs; words are few, so that shingles recur."""
    monkeypatch.setattr(r, "FIRST_WAVE", first_wave)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        base = [f"w{'abcd'[int(x)]}" for x in rng.integers(0, 4, int(rng.integers(1, 120)))]
        for j in range(5):
            words = base if j == 0 else reworded(rng, base, min(len(base), int(rng.integers(0, 3))))[: len(base) - int(rng.integers(0, 2))] or base
            hashes = r.shingle_hashes(words)
            rows.append((f"{i}-{j}", " ".join(words), r.simhash(words), len(hashes), r.prefix(hashes), "error page" if j in (0, 3) else None, bool(i % 7 == 0 and j > 2)))
    data = spark.createDataFrame(rows, "node string, words string, hash long, n_shingles int, prefix array<int>, kind string, hunks boolean")
    found = {x["node"] for x in r.similar_labelled(data.where(F.col("kind").isNull()).drop("kind"), data.where(F.col("kind").isNotNull())).collect()}
    pairs = {(a[0], b[0], bin((a[2] ^ b[2]) & (2**64 - 1)).count("1")) for a in rows if a[5] for b in rows if not b[5] and a[6] == b[6] and r.similarity(a[1], b[1]) >= r.SIMILARITY}
    assert found == {b for _, b, _ in pairs} and any(distance > r.MAX_DISTANCE for *_, distance in pairs)


def test_labels_reach_reworded_residue(spark):
    """Two words changed, no sign left, further apart in SimHash than any table reaches."""
    first = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)]
    first[40:43] = ["not", "found", "here"]
    second = [*first[:40], "moved", "over", "there", *first[43:]]
    texts = [" ".join(first), " ".join(second), " ".join(second) + HUNK, " ".join(reversed(second))]
    assert r.judge(texts[1], True) is None and not near(first, second) and r.similarity(*texts[:2]) >= r.SIMILARITY
    assert {x["doc_id"] for x in r.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == {0, 1}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_some_table_always_agrees(value, flipped):
    other = value
    for bit in flipped:
        other ^= 1 << bit
    starts = np.cumsum((0, *r.BLOCK_BITS))
    block = lambda v, b: v >> int(starts[b]) & ((1 << r.BLOCK_BITS[b]) - 1)
    assert any(all(block(value, b) == block(other, b) for b in kept) for kept in combinations(range(len(r.BLOCK_BITS)), len(r.BLOCK_BITS) - r.MAX_DISTANCE))


def test_vocabulary_of_filler(spark):
    latin = ["velit", "totem", "amur", "vando", "modus", "pellis", "sidera"]
    rows = [(f"f{i}", " ".join(["lorem", *latin[i % 3 :], *latin]), i, r.FILLER) for i in range(5)]
    rows += [("hidden", " ".join(latin), 99, None), ("plain", "fix the modus of the reader in old clusters", 100, None), ("short", "velit totem", 101, None)]
    assert [x["node"] for x in r._vocabulary_filler(nodes(spark, rows)).collect()] == ["hidden"]


def test_latin_words_that_are_english_too():
    classic = "Lorem ipsum dolor sit amet. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum."
    assert r.judge(classic, False) == r.FILLER
    for talk in ("Use lorem ipsum in tests", "Show a lorem ipsum", "Drop lorem ipsum dolor sit amet from the demo in a fixture"):
        assert r.judge(talk, False) is None


def test_similarity_and_simhash():
    assert r.shingles(["a", "b"]) == {"a b"} and r.similarity("a b c d e", "a b c d e") == 1.0
    assert r.simhash(["a"] * 5) == r.simhash(["a"] * 9)
    assert r.masked_words("Code 3c060a3085, wait 12 s ${X}") == ["code", "0", "wait", "0", "s", "__hole__"]


def test_labels_pass_through_stock_sentences(spark):
    """No sign and no near-duplicate: a unit in the place of a diff is linked by a sentence a quarter of whose units are residue, and by what it links in turn."""
    stock, other, common = "kindly wait while we look for it", "nothing can be shown at the moment", "see the notes of the last meeting"
    signed = [f"The {x} is overloaded. {stock.capitalize()}. {common.capitalize()}." for x in ("mirror", "archive", "gateway")]
    texts = [*signed, f"Lost in the woods. {stock}. {other}.", f"Broken glass all over. {other}.", f"Moved to a new house. {other}. " + "far too long for one known sentence to tell " * 4, stock + HUNK, *(f"Plan number {'abcdefghijklm'[i]} follows. {common}." for i in range(13))]
    found = {x["doc_id"]: x["kind"] for x in r.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0).collect()}
    assert found == {0: r.ERROR, 1: r.ERROR, 2: r.ERROR, 3: r.LINKED, 4: r.LINKED}


@pytest.mark.parametrize("sample, most", [(20_000, 1), (0, 0)])
def test_words_of_signed_nodes_tell_unsigned_ones(spark, sample, most):
    """A unit that shares the words, but no sentence, of signed pages is found by the model; one of a commit's words is not."""
    rng = np.random.default_rng(5)
    pages = ["browser", "viewer", "visitor", "network", "reload", "gateway"]
    plain = ["reader", "index", "cursor", "loader", "schema", "header", "buffer"]
    some = lambda words, n: " ".join(words[int(i)] for i in rng.permutation(len(words))[:n])
    texts = [f"{some(pages, 4)} not found {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    texts += [f"{some(plain, 4)} {some(pages, 1) if i < 5 else ''}{HUNK}" for i in range(200)]
    texts += ["network browser reload", "cursor schema header"]
    found = {x["doc_id"]: x["kind"] for x in r.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sample).collect()}
    assert set(range(60)) <= set(found) and {d: k for d, k in found.items() if d >= 60} == ({260: r.WORDING} if most else {})


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "asdf asdf asdf"), (2, "x" * 300_000)]])
def test_edges(spark, rows):
    found = r.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in found] == ([None] if len(rows) > 1 else [])
