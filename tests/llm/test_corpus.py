"""Corpus operators against brute force, exact libraries and awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from learnmill.llm import bpe, decontaminate, fpindex, html, linededup, neardup, quality, simhash, tokencount, toxicity, urls
from learnmill.llm.common import Forest, connected_components

SCHEMA = "doc_id long, text string, lang string, n long, k string, h string, count long"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 7, "k", "h", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(r, n, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "one", "é ü 日本 😀", "a b c " * 400, "x" * 5000, "Line one here.\n\nLine one here.\n"]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[500] == 500


def test_url_rules(spark):
    rows = [(1, "http://blog.example.net/en/x?q"), (2, "http://example.net/fr/"), (3, "https://a.EXAMPLE.com/de/1#t"), (4, "http://x.org/fr/z"), (5, None), (6, "nothing"), (7, "http://net"), (8, "http://example.net-x.org/fr/"), (1, "http://blog.example.net/en/x?q")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame([(*r, "key") for r in rows], "page_id long, url string, key string"), urls.rules_frame(spark)).collect())
    assert got[0] == got[1] == (1, "blog.example.net", "/en/x", "example.net/en/", "allow")
    assert [g[3:] for g in got[2:]] == [("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow")]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.rules_frame(spark)).count() == 0


def test_quality_counts(spark):
    texts = [*AWKWARD, "a b c d a b c", "Good line with words.\nNav | one | two\nAll rights reserved."]
    got = {r["doc_id"]: r for r in quality.clean_lines(docs(spark, texts)).collect()}
    assert [got[i]["n_words"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert got[9]["n_repeat_words"] == 6 and got[8]["n_dup_lines"] == 1
    assert got[10]["clean_text"] == "Good line with words." and got[10]["n_lines_removed"] == 2
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        cover = {j + d for j, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)} if len(w) < 3000 else None
        assert cover is None or got[i]["n_repeat_words"] == len(cover)


def test_tokens_equal_the_library(spark):
    import tokenizers

    from learnmill.llm.wordbpe import default_vocabulary

    tool = tokenizers.Tokenizer.from_file(default_vocabulary())
    r = random.Random(3)
    bits = ["a", "aa", "the", "ing", "é", "İ", "ΑΣ", "1", "½", "'s", "!!", " ", "\x1c", "　", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "😀", "\xa0"]
    texts = [*AWKWARD, *("".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(200))]
    want = [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {x["doc_id"]: x for x in bpe.encode_decode(docs(spark, texts)).collect()}
    assert [list(got[i]["ids"]) for i in range(len(texts))] == want
    assert [got[i]["decoded"] for i in range(len(texts))] == [tool.decode(w, skip_special_tokens=False) for w in want]
    counts = {x["doc_id"]: x for x in tokencount.count_tokens(docs(spark, texts), limit=10).collect()}
    assert [counts[i]["n_tokens"] for i in range(len(texts))] == [len(w) for w in want]
    assert all(counts[i]["over_limit"] == (len(w) > 10) for i, w in enumerate(want))
    d = bpe.digests(bpe.encode_decode(docs(spark, ["the end"]))).first()
    assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, tool.encode("the end", add_special_tokens=False).ids)).encode()).hexdigest()


def test_simhash_components_match_brute_force(spark):
    r = random.Random(1)
    base = [prose(r, 60) for _ in range(20)]
    texts = [*AWKWARD, *base, *base[:5], *(t + " tail" for t in base)]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    forest = Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                forest.join(i, j)
    assert [got[i]["component_id"] for i in range(len(texts))] == [forest.find(i) for i in range(len(texts))]
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs(spark, texts), size=3).collect()) == [i for i in range(len(texts)) if forest.find(i) == i]


def test_blocks_of_a_hot_cell_lose_no_link(spark):
    rows = [(i, i & 7) for i in range(8)] + [(100 + i, (0xFFFFF << 30) + i) for i in range(4)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    whole = {tuple(x) for x in connected_components(simhash.near_links(nodes)).collect()}
    parts = {tuple(x) for x in connected_components(simhash.near_links(nodes, block=2)).collect()}
    assert whole == parts and len({c for _, c in whole}) == 2


def test_pipeline_stage_drops_edited_near_copies(spark):
    import corpus_pipeline

    r = random.Random(9)
    base = [prose(r, n, 5000) for n in (60, 150, 150, 300, 300, 600) * 5]
    near = []
    for t in base:
        w = t.split()
        for _ in range(max(1, len(w) // 100)):
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    far = [" ".join(x for w in t.split() for x in ([w, "new"] if r.random() < 0.1 else [w])) for t in base[:5]]
    texts = [*AWKWARD, *base, *near, *far, base[0] + "  ", base[3].upper()]
    sets = [set(neardup.shingle_set(t).tolist()) for t in texts]
    forest = Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                forest.join(i, j)
    want = [i for i in range(len(texts)) if forest.find(i) == i]
    d = docs(spark, texts).unionByName(docs(spark, [base[0]], [None]))
    for kept in (corpus_pipeline.drop_near_copies(spark, d, ""), neardup.keep_one(d, block=2)):
        got = [x["doc_id"] for x in kept.collect()]
        assert sorted(i for i in got if i is not None) == want and got.count(None) == 1
    assert len(want) < len(texts) - 25 and neardup.keep_one(docs(spark, [])).count() == 0


def substrings_removed(texts):
    """By text in order: (words, words removed, kept text), by brute force."""
    seen, want = set(), []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").split()
        gone, own = set(), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen or k in own:
                gone.update(range(s, s + 20))
            own.add(k)
        seen |= own
        want.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return want


def repeating_texts(r):
    shared, other = prose(r, 45), prose(r, 150)
    near = other.split()
    for i in (30, 60, 61, 90, 149):
        near[i] = "changed"
    return [
        *AWKWARD, *(f"{prose(r, 30)} {shared} {prose(r, 25)}" for _ in range(5)), shared, prose(r, 19), "z " * 60, other, " ".join(near), other, f"{shared} {other[200:]} {shared}",
        f"x {other} y {other[50:]}", "again and " * 30,
    ]


def test_small_groups_of_lines_are_kept_apart():
    lines = ["the same line of words", "the same line of words!", "another line of words", "the same line of words", "the same line of words?", "x"]
    got = linededup.similar_in_small_groups(lines, [0, 0, 0, 1, 1, 1], [None] * 6, 5, 0.8)
    assert got == [(0, 1), (3, 4)]


def test_substring_dedup_matches_brute_force(spark):
    texts = repeating_texts(random.Random(2))
    want = dict(enumerate(substrings_removed(texts)))
    for batches in (1, 4):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in fpindex.dedup_substrings(docs(spark, texts), batches=batches).collect()}
        assert got == want
    assert fpindex.dedup_substrings(docs(spark, [])).count() == 0


def test_substring_dedup_takes_any_id_and_repeated_rows(spark):
    r = random.Random(12)
    a, b = prose(r, 40), prose(r, 40)
    texts, ids = [a, f"{a} {b}", b, b, f"{b} tail", b], [-(2**62), 2**62, 2**62 + 1, 2**62 + 1, 2**62 + 2, None]
    got = sorted((x["doc_id"] or 0, x["n_removed"]) for x in fpindex.dedup_substrings(docs(spark, texts, ids)).collect())
    assert got == [(-(2**62), 0), (0, 0), (2**62, 40), (2**62 + 1, 40), (2**62 + 1, 40), (2**62 + 2, 40)]


def test_fingerprint_index_goes_on_when_opened_again(spark, tmp_path):
    texts = repeating_texts(random.Random(5))
    want = substrings_removed(texts)
    folder = f"{tmp_path}/index"
    for lo in range(0, len(texts), 6):
        index = fpindex.FingerprintIndex(spark, folder)  # as another job would
        assert len(index.texts) == lo // 6
        batch = spark.createDataFrame(list(enumerate(texts))[lo : lo + 6], "doc long, text string")
        pieces = index.add(batch)
        got = {x["doc"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in fpindex.cut(batch, pieces, "doc", "bigint").collect()}
        assert got == {i: want[i] for i in range(lo, min(lo + 6, len(texts)))}
    assert len(index.runs) <= 2
    index.close()


def test_equal_hashes_are_verified_by_words(spark, monkeypatch):
    words = [f"w{i}".encode() for i in range(40)]
    span = [{"span": 0, "at": 0, "size": 30, "skip": 0, "words": b" ".join(words[:30])}, {"span": 1, "at": 20, "size": 20, "skip": 0, "words": b" ".join(words[20:39]) + b" other"}]
    assert fpindex.verified_cover(words, span).sum() == 30


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(6)
    lines = [prose(r, 12, 3000) for _ in range(30)]
    near = [x[:-3] + "zzz" for x in lines[:10]]
    texts = [*AWKWARD, *("\n".join(r.sample(lines + near, 6)) for _ in range(12))]
    order, first = {}, {}
    for t in texts:
        for line in linededup.normal_lines(t):
            order.setdefault(line, len(order))
    names = list(order)
    sets = [linededup.shingles(x) for x in names]
    forest = Forest(len(names))
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
    seen, want = set(), []
    for t in texts:
        gone = 0
        for line in linededup.normal_lines(t):
            c = forest.find(order[line])
            gone += c in seen
            seen.add(c)
        want.append(gone)
    got = {x["doc_id"]: x for x in linededup.dedup_lines(docs(spark, texts), block=3).collect()}
    assert [got[i]["n_lines_removed"] for i in range(len(texts))] == want
    assert got[0]["text"] is None and got[4]["text"] == "" and first == {}


def test_line_dedup_takes_any_id_and_repeated_rows(spark):
    big = 2**62
    texts = ["same line of words here\nown line one", "same line of words here\nown line two", "same line of words here\nown line two", None, "same line of words here\nsame line of words here"]
    got = linededup.dedup_lines(docs(spark, texts, [-5, big, big, 7, None])).collect()
    by_id = {}
    for x in got:
        by_id.setdefault(x["doc_id"], []).append((x["text"], x["n_lines_removed"]))
    assert by_id == {-5: [(texts[0], 0)], big: [("own line two", 1)] * 2, 7: [(None, 0)], None: [("same line of words here", 1)]}
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    kept = linededup.cut_lines(docs(spark, texts).withColumn("n_lines", F.lit("mine")))
    assert kept.columns == [*docs(spark, []).columns, "n_lines"] and {x["n_lines"] for x in kept.collect()} == {"mine"}


def test_line_bands_meet_at_the_threshold():
    r = random.Random(9)
    met = 0
    for _ in range(300):
        base = "".join(r.choice("abcdefghij ") for _ in range(200))
        other = base
        while True:  # edits until the next one would fall under the threshold
            i = r.randrange(len(other))
            nxt = other[:i] + "#" + other[i + 1 :]
            p, q = linededup.shingles(base), linededup.shingles(nxt)
            if len(p & q) < 0.8 * len(p | q):
                break
            other = nxt
        keys = linededup.band_keys([base, other], linededup.K, linededup.BANDS, linededup.ROWS)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.97 * 300


def test_line_pairs_in_arrays_equal_those_of_sets():
    r = random.Random(10)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    lines = [x[:i] + "#" + x[i + 1 :] for x in base for i in (3, 20, 40, 59)] + ["short", "shorts"]
    own = [r.randrange(2) for _ in lines]
    for block in (None, own):
        forest, want = Forest(len(lines)), Forest(len(lines))
        for x, y in linededup.similar_pairs(lines, block, 10, 0.8):
            forest.join(x, y)
        small = Forest(len(lines))
        for x, y in linededup.similar_in_small_groups(lines, [0] * len(lines), block or [None] * len(lines), 10, 0.8):
            small.join(x, y)
        assert [forest.find(i) for i in range(len(lines))] == [small.find(i) for i in range(len(lines))]
        sets = [linededup.shingles(x) for x in lines]
        for y in range(len(lines)):
            for x in range(y):
                if (block is None or block[x] != block[y]) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                    want.join(x, y)
        assert [forest.find(i) for i in range(len(lines))] == [want.find(i) for i in range(len(lines))]


def test_decontamination_finds_edited_passages(spark):
    r = random.Random(8)
    items = [prose(r, n, 5000) for n in (14, 25, 40, 59)]
    texts = list(AWKWARD)
    for t in items:
        w = t.split()
        for _ in range(decontaminate.allowed(len(w)) // 2):
            w[r.randrange(len(w))] = "changed"
        texts.append(prose(r, 80, 5000) + " " + " ".join(w) + "\n" + prose(r, 50, 5000))
    texts += [prose(r, 200, 5000) for _ in range(5)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs(spark, texts), bench, block_bytes=200).collect()}
    assert got == {(len(AWKWARD) + k, k) for k in range(4)}
    assert decontaminate.drop_leaking(docs(spark, texts), bench).count() == len(texts) - 4
    assert decontaminate.find_leaks(docs(spark, texts), bench.where("false")).count() == 0


def edited(r, words, kind, n):
    words = list(words)
    for _ in range(n):
        how, i = r.choice(["change", "insert", "delete"]) if kind == "mixed" else kind, r.randrange(len(words))
        if how == "delete":
            del words[i]
        else:
            words[i : i + (how == "change")] = [f"new{r.randrange(10**6)}"]
    return words


def test_decontamination_recall_at_the_full_allowance():
    """The target: 0.95 at every length and for every kind of edit, with as many edits as are allowed."""
    r = random.Random(3)
    for n in (5, 9, 15, 25, 40, 41, 59, 120, 300):
        items = [(i, prose(r, n, 5000)) for i in range(30)]
        index, found, tried = decontaminate.BenchmarkIndex(items), 0, 0
        for kind in ("change", "insert", "delete", "mixed"):
            texts = [f"{prose(r, 60, 5000)} {' '.join(edited(r, t.split(), kind, decontaminate.allowed(n)))} {prose(r, 60, 5000)}" for _, t in items]
            got = {(i, k) for i, k, _, _ in index.find_many(texts)}
            found, tried = found + sum((i, i) in got for i in range(30)), tried + 30
        assert found >= 0.95 * tried, n


def test_decontamination_matches_brute_force(spark):
    r = random.Random(14)
    items = [prose(r, n, 40) for n in (1, 2, 4, 5, 8, 12, 20, 45, 20)] + ["w1 w2 w3 w4 w5 w6", "w1 w2 w3 w4 w5 w6", "?!", None]
    texts = [*AWKWARD, *(prose(r, 60, 40) for _ in range(20)), "w1 w2 w3 w4 w5 w6"]
    texts += [f"{prose(r, 10, 40)} {' '.join(edited(r, t.split(), 'mixed', decontaminate.allowed(len(t.split()))))}" for t in items[:9]]
    want = set()
    for k, t in enumerate(items):
        item = decontaminate.words_of(t)
        most = decontaminate.allowed(len(item))
        for i, text in enumerate(texts):
            number = {w: j for j, w in enumerate({*item, *decontaminate.words_of(text)})}
            if item and decontaminate.passage_distance([number[w] for w in item], [number[w] for w in decontaminate.words_of(text)], most)[0] <= most:
                want.add((i, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and {p for p in want if p[1] in (0, 1, 2, 9, 10)} <= got
    twice = docs(spark, [texts[-1]] * 2 + ["plain text " * 100_000], [5, 5, None])
    assert {x["doc_id"] for x in decontaminate.find_leaks(twice, bench).collect()} == {5}
    assert decontaminate.drop_leaking(twice, bench).count() == 1 and decontaminate.drop_leaking(docs(spark, []), bench).count() == 0


def test_html_blocks_and_held_out_pages(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  <b>para</b>graph of the text.<p>Second one, with more words in it.</article><aside><p>Other stories today.</p></aside><div class='comments'><p>Nice post.</p></div><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut &am"), (5, "x", "<<<>&#0;</p")]
    got = {x["page_id"]: x for x in html.main_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "A & B First paragraph of the text. Second one, with more words in it."
    assert got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    chain = html.trained()
    pages = html.training_set(80, 1234)
    wrong = sum(a != b for rows, y in pages for a, b in zip(chain.viterbi(chain.scores(rows)), y, strict=True))
    assert wrong / sum(len(y) for _, y in pages) < 0.02


def test_html_features_see_the_whole_block():
    page = f"<div>{'word ' * 100}all rights reserved, accept every cookie</div>"
    assert {"says:all rights", "says:cookie"} <= set(html.features(html.blocks_of(page)[0]))


def test_toxicity_learns_folds_and_excepts(spark):
    r = random.Random(4)
    texts = [prose(r, 40, 2000) + (" you idiot and scumbag" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs(spark, texts), labels, exceptions=("idiot light",))
    tool = toxicity.Matcher(lexicon)
    assert tool.score("an idiot and scumbag said so") >= 0.7 and tool.score("аn 1d1ot and scumb@g said so") >= 0.7
    assert max(tool.score(t) for t in (None, "", "a calm text of words", "the idiot light is on")) < 0.5
    scored = toxicity.toxicity(docs(spark, AWKWARD), labels.where("false")).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= x["score"] <= 1 for x in scored)


def test_held_out_rows_follow_crc(spark):
    import zlib

    got = {x["id"]: x["h"] for x in spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(50))


def test_pipeline_runs_and_filters(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert 0 < out.count() < spark.read.parquet(f"{d}/documents.parquet").count()
    assert out.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0
