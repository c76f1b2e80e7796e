"""The text operators against brute force, on small and awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import ann, decontam, graph, html, langid, minhash, packing, sharding, suffix, toxicity, urls
from cladeframe.llm.common import table
from cladeframe.session import cut

SYLLABLES = {"en": "the of ing er and th".split(), "fr": "le eau oi ère qu ai".split(), "de": "sch ung ein keit zu ä".split()}


def prose(rng, words, lang="en"):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def messy_texts():
    rng = random.Random(1)
    texts = [None, "", " \t\n ", "one", "one", "!!! ??", "ß", "x" * 250]
    base = [prose(rng, rng.randint(20, 120), rng.choice(list(SYLLABLES))) for _ in range(25)]
    passage = prose(rng, 60)
    for t in base:
        texts.append(t)
        if rng.random() < 0.5:
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(prose(rng, 10) + " " + passage + " " + prose(rng, 10))
    texts += [texts[-1]] * 3
    texts.append(" ".join(prose(rng, 200) for _ in range(60)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with clashing column names, null ids, repeated rows."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), i, "h", 1.0) for i, t in enumerate(messy_texts())]
    rows += [(None, "no id here at all", "en", "s", 3, 0, "", 0.0), (None, None, None, None, None, None, None, None), rows[12]]
    return cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size double"))


@pytest.fixture(scope="module")
def empty_docs(docs):
    return docs.where("false")


def own_row(docs):
    """(doc_id, text) with the result columns of a query joined on the id, for rows with one."""
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct()


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    linked = {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} - {()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_all_pairs(docs, size):
    rows = own_row(docs).collect()
    sets = {r[0]: shingles(r[1], size) for r in rows}
    part = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and part[a] is not part[b]:
                part[a] |= part[b]
                for v in part[b]:
                    part[v] = part[a]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs.where("doc_id IS NOT NULL"), size).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: min(part[i]) for i in sets}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_keep_one_of_each(docs, empty_docs):
    kept = minhash.one_of_each(docs, size=2).collect()
    assert kept[0].__fields__ == docs.columns
    assert sum(r["text"] == "one" for r in kept) == 1
    assert minhash.near_duplicates(empty_docs).count() == 0 and minhash.one_of_each(empty_docs).count() == 0
    every = minhash.near_duplicates(docs)
    assert every.count() == docs.count()


def test_open_buckets_are_settled_pair_by_pair(spark):
    # A chain: neighbours are alike, ends are not, so one pivot cannot settle the bucket.
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[5 * i:5 * i + 80])) for i in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1, pivots=()).collect()
    assert {r["component_id"] for r in got} == {0}


def test_words_built_to_collide_stay_apart(spark):
    # Thue-Morse words and their complements have equal sums of powers modulo 2**64, whatever the base.
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate({97: 98, 98: 97})
    rows = [(1, f"{one} x"), (2, f"{two} x"), (3, f"{one} x {two} x")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {1: (1, 1), 2: (1, 2), 3: (3, 3)}


def covered(texts, window):
    octets = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + window] for b in octets for i in range(len(b) - window + 1))
    out = []
    for b in octets:
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                hit[i:i + window] = b"\1" * window
        out.append((len(b), sum(hit), sum(hit[i] > (hit[i - 1] if i else 0) for i in range(len(b))),
                    hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 15, 2])
def test_repeats_match_brute_force(docs, most):
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, covered([r[1] for r in rows], 200)))
    got = suffix.repeats(docs, 200, most).drop("spans").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_repeats_of_periodic_and_short_passages(spark):
    rng = random.Random(5)
    shared = prose(rng, 80)
    texts = ["a" * 700, "ab" * 300, "é" * 150, shared[:200], "q" + shared[1:201], shared[:199] + "!", prose(rng, 5) + shared[40:260] + "z" * 9, "k" + shared[40:259]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:5] for r in suffix.repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == covered(texts, 200)


def test_stripped_text_keeps_whole_characters(docs, empty_docs):
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> char_length(text)").count() == 0
    assert suffix.repeats(empty_docs).count() == 0 and suffix.without_repeats(empty_docs).count() == 0


def test_loser_tree_merges_with_known_prefixes():
    rng = random.Random(9)
    for k in (1, 2, 3, 7):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))}) for _ in range(k)]
        sources = [suffix.decoded(suffix.front_code(r, list(range(len(r))), [False] * len(r))) if r else iter(()) for r in runs]
        got = [(item[0], prefix) for _, item, prefix in suffix.merged(sources)]
        keys = sorted(x for r in runs for x in r)
        assert [g[0] for g in got] == keys
        assert [g[1] for g in got][1:] == [suffix.shared_prefix(a, b) for a, b in zip(keys, keys[1:])]


def words_of(text):
    return [w.decode() for w in "".join(chr(b) if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else " " for b in (text or "").encode().lower()).encode("latin1").split(b" ") if w]


def test_contamination_matches_brute_force(spark, docs, empty_docs):
    rng = random.Random(4)
    long = [t for t in messy_texts() if t and len(t.split()) > 40]
    items = [(0, " ".join(long[0].split()[3:20])), (1, long[1]), (10, "ONE"), (11, "one"), (2, ""), (3, None), (4, prose(rng, 30)),
             (5, " ".join(long[2].split()[:9])), (6, "of the"), (1, long[1])]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, words long")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for a in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[a:a + 10])].add(i)
    want = collections.Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        w, hit, found = words_of(text), set(), set()
        for win, names in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[(doc_id, len(w), len(hit), len(found), digest, bool(hit))] += 1
    got = decontam.contamination(docs, bench).drop("row").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert decontam.contamination(empty_docs, bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).where("contaminated OR n_hit > 0").count() == 0


def best_fit(lengths, width):
    """Room left in every sequence after best fit, longest first, one by one."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        room = min(fits, default=width)
        if fits:
            rooms.remove(room)
        rooms.append(room - length)
    return rooms


def test_packing_is_gapless_and_tight(docs, empty_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = packing.pack(docs, width=256).collect()
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in own_row(docs).collect()}
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
            assert r["length"] == 256 or r["piece"] == 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) == len(best_fit([r["length"] for r in got], 256))
    assert packing.pack(empty_docs).count() == 0


def test_special_strings_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"a  {end}  b{end}{end}\n\n", "<|endoftext|", f"it's{end}'s é ", end * 300, "no such string"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in packing.pack(rows, width=256).collect()}
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (50256 in ids) == (end in text)
        first = (len(ids) - 1) % 256 + 1
        for part in (ids[:first], *(ids[a:a + 256] for a in range(first, len(ids), 256))):
            at = sum(n for (doc, _), (n, _) in want.items() if doc == i)
            want[i, at] = (len(part), zlib.crc32(part.tobytes()))
    assert got == want


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(8)}
        rooms = best_fit([length for length, n in counts.items() for _ in range(n)], 50)
        plan = packing.plan(counts, 50)
        used = collections.Counter()
        for length, low, high, first, each, base in plan:
            for rank in range(low, high):
                used[first + (rank - low) // each] += length
        assert len(used) == len(rooms) and sorted(50 - u for u in used.values()) == sorted(rooms)


def test_shards_are_minimax(docs, empty_docs):
    got = sharding.shard(docs, 5).collect()
    assert len(got) == docs.count()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    groups = collections.OrderedDict()
    for r in sorted(sharding.sized_rows(docs).collect(), key=lambda r: r["key"]):
        groups[r["key"]] = groups.get(r["key"], 0) + r["size"]

    def shards_at(capacity):
        n, room = 0, 0
        for g in groups.values():
            if g > capacity:
                return 99
            if g > room:
                n, room = n + 1, capacity
            room -= g
        return n

    best = next(c for c in range(max(groups.values()), sum(groups.values()) + 1) if shards_at(c) <= 5)
    assert max(size.values()) == best
    for shard in size:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty_docs, 5).count() == 0


def test_no_shard_is_empty_beside_a_group_of_a_third(spark):
    ordered = sorted((f"{i:09d}" for i in range(200)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    texts = ordered + [ordered[100]] * 99
    got = collections.Counter()
    for r in sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).collect():
        got[r["shard"]] += r["size"]
    assert sorted(got) == list(range(16)) and max(got.values()) == 1000
    assert sorted(got.values())[-2] <= 150
    few = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], "doc_id long, text string")
    assert {r["shard"] for r in sharding.shard(few, 4).collect()} == {0, 1, 2, 3}


def test_segments_are_maximal():
    rng = np.random.default_rng(1)

    def brute(s, lo, hi):
        """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
        best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, a, b = best
        return brute(s, lo, a) + [(a, b)] + brute(s, b, hi)

    for _ in range(60):
        s = rng.normal(-0.3, 1, 14).round(3)
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s, 0, len(s))


def test_toxicity_finds_held_out_passages(spark, docs, empty_docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, rng.randint(5, 80)).split(), int(rng.random() < 0.3)
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "scumbag"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(texts, known).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(bool(got[i]["passages"]) for i, _, t in labels if t and got[i]["predicted"])
    awkward = toxicity.score(docs, known)
    assert awkward.count() == docs.count() and awkward.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(docs, known.where("false")).where("predicted = 1").count() == 0
    assert toxicity.score(empty_docs, known).count() == 0


def test_language_is_identified(spark, docs, empty_docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(3, 60), lang), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... 4", "de"), (1003, "日本", None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(texts).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows[:400] if got[i]["held_out"]]
    assert len(held) > 40 and sum(held) / len(held) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] != "und"
    assert langid.identify(docs).count() == docs.count() and langid.identify(empty_docs).count() == 0
    assert {r[0] for r in langid.identify(texts.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8))
    m = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 8))).astype(np.float32)
    m[100:400] = m[50]
    rows = [(i, [float(x) for x in v], 1, 2) for i, v in enumerate(m)]
    rows += [(2000, None, 1, 2), (2050, [0.0] * 8, 1, 2), (2100, [float("nan")] * 8, 1, 2), (2150, [None] * 8, 1, 2), (2200, [1.0], 1, 2), (None, [1.0] * 8, 1, 2)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, v int")
    got = collections.defaultdict(dict)
    for r in ann.search(table_).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    d = m.astype(float)
    hit = 0
    assert set(got) == set(range(0, 1500, 50))
    for q in got:
        s = ann.cosines(d, np.broadcast_to(d[q], d.shape))
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s[v] - x) < 1e-12 for v, x in got[q].values())
        hit += len(set(order) & {v for v, _ in got[q].values()})
    assert hit / (5 * len(got)) >= 0.95
    assert [got[100][r][0] for r in (1, 2, 3)] == [50, 101, 102]
    few = ann.search(table_.where("vec_id IN (0, 1, 2)")).collect()
    assert len(few) == 2 and ann.search(table_.where("false")).count() == 0
    assert ann.search(table_.where("vec_id = 2050")).count() == 0


def test_neighbours_of_an_outlier_are_complete(spark, monkeypatch):
    # Leaves of one or two vectors, and one leaf for every query.
    monkeypatch.setattr(ann, "grow", lambda vectors, n: ann.Tree(ann._unit(np.array([r["v"] for r in vectors.orderBy("vec_id").collect()])), 100))
    monkeypatch.setattr(ann, "calibrate", lambda *a, **b: 1)
    m = np.random.default_rng(2).normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(50, m[50].tolist()), (50, m[51].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert collections.Counter(r["query_id"] for r in got) == {0: 5, 50: 5, 100: 5, 150: 5}
    assert all(r["query_id"] != r["vec_id"] for r in got)


def test_url_rules_and_mined_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    given = ["https://Example.ORG/es/1?x#y", "http://a.example.org/en", "http://org", "http://notorg/", "http://a.com/de/1", "ftp://b.com/fr/#t", "no url", None, "",
             "://h?/q", "http://x.net/spam/77?id=4"]
    rows = [(i, u, "x", "y") for i, u in enumerate(given)]
    rows += [(100 + i, f"http://s{i % 7}.net/{'spam' if i % 3 == 0 else 'news'}/{i}", "x", "y") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, tokens string, rule string")
    labels = spark.createDataFrame([(100 + i, i % 3 == 0) for i in range(60)] + [(None, True), (100, None)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, labels, rules, 0.05, 0.6).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(given))] == [
        ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en", "org/", "allow"), ("org", "", None, "allow"), ("notorg", "/", None, "allow"),
        ("a.com", "/de/1", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h", "", None, "allow"), ("x.net", "/spam/77", None, "block")]
    assert all(got[100 + i]["verdict"] == ("block" if i % 3 == 0 else "allow") for i in range(90))
    assert urls.judge(pages, labels.where("false"), rules).where("confidence IS NOT NULL").count() == 0
    assert urls.judge(pages.where("false"), labels, rules).count() == 0


def test_a_template_of_many_tokens_is_one_item(spark):
    keys = "&".join(f"k{i}=1" for i in range(40))
    rows = [(i, f"http://s{i % 5}.net/{'shop' if i % 4 == 0 else 'news'}/{i}" + (f"?{keys}" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(900, "http://other.net/x?k3=2"), (901, "http://other.net/x?k=2")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, []).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(200)) and got[900] == "block" and got[901] == "allow"


def test_rules_match_brute_force_and_chance_gives_none(spark):
    rng = random.Random(19)
    sets = [sorted({rng.choice("abcdef") for _ in range(4)} | ({"x", "y"} if rng.random() < 0.3 else set())) for _ in range(300)]
    bad = [("x" in s and "a" in s) or rng.random() < 0.1 for s in sets]

    def rules(bad):
        rate, need, every = sum(bad) / 300, max(1.0, 0.05 * 300), set()
        tokens = sorted(set(t for s in sets for t in s) - {"y"})  # x and y come together
        for n in range(1, len(tokens) + 1):
            every.update(c for c in itertools.combinations(tokens, n) if sum(set(c) <= set(s) for s in sets) >= need)
        found = {}
        for c in every:
            labels = [b for s, b in zip(sets, bad) if set(c) <= set(s)]
            share = sum(labels) / len(labels)
            if sum(labels) >= need and share >= 0.6 and share > rate:
                rest = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0
                if len(labels) * (share * math.log(share / rate) + rest) >= math.log(len(every) / 0.01):
                    found[c] = share
        return {c: s for c, s in found.items() if not any(set(d) < set(c) and found[d] >= s for d in found)}

    shuffled = rng.sample(bad, 300)
    for flags in (bad, shuffled):
        got, names = urls.mine(spark.createDataFrame(list(enumerate(sets)), "row long, tokens array<string>"),
                               spark.createDataFrame(list(enumerate(flags)), "row long, bad boolean"), 0.05, 0.6)
        want = rules(flags)
        assert {tuple(r["antecedent"]): round(r["confidence"], 9) for r in got.collect()} == {c: round(s, 9) for c, s in want.items()}
        assert bool(want) == (flags is bad)
        assert {tuple(r) for r in names.collect()} == ({(t, "x" if t == "y" else t) for c in want for t in (*c, *("y" if "x" in c else ""))})


def test_blocks_of_awkward_markup():
    assert html.blocks("<div class=nav>x</div><p>Hello &amp; <i>wor</i>ld<p>two<ul><li>a<li>b</ul>") == (["Hello & world", "two", "a", "b"], False)
    assert html.blocks("<article><p>A<div class='comments'>no</div><p>B</article><p>C") == (["A", "B"], True)
    assert html.blocks("<main><h1>T</h1><header>h</header><section>a\n b&nbsp;c</section></main>") == (["T", "a b c"], True)
    assert html.blocks("<p>x &lt;b&gt; <script>if(a<b)'</p>'</script> y<!-- <p>z") == (["x <b> y"], False)
    for broken in ("", "<", "<p", "x < y", "</p></div>", "<article", '<a title="abc>t</a>', "<!--", "<p>" * 5000):
        html.blocks(broken)


def test_wrappers_lose_only_what_their_class_names():
    assert html.blocks("<form id='aspnetForm'><div id='header'>Site</div><div id='content'><p>the body text</div><label>L</label></form>") == (["the body text"], False)
    assert html.blocks("<div class='page no-sidebar'><article><p>body</article></div>") == (["body"], True)
    assert html.blocks("<div class='layout has-sidebar'><p>body</div><div class='sidebar'>side</div>") == (["body"], False)
    assert html.blocks("<div class='header wrap'><div class='ad'>x</div><article><p>body<p class='related-work'>more<p class='ad-text'>no</article></div>") == (["body", "more"], True)
    assert html.blocks("<article><p>body</article><div class='widget'><article>card text that is longer</article></div>") == (["body"], True)
    assert html.blocks("<div class='comments'><article>me too</article></div><p>body") == (["body"], False)
    assert html.blocks("<div class=nav><a href=x>a long menu of many words</a></div><p>short") == (["short"], False)
    assert html.blocks("<div class='comments'>only</div>") == ([], False)


def test_time_of_broken_markup_grows_with_its_length():
    for part in ("<b>x</i>", "<p>", "<li>", "<div class=ad><article>x"):
        begin = time.process_time()
        html.blocks(part * 50_000)
        assert time.process_time() - begin < 10, part
    html.blocks("<span>" * 50_000 + "<h1>x" * 50_000)


def test_shared_paragraphs_and_headings_of_articles_stay(spark):
    rng = random.Random(17)
    shared, own = [prose(rng, 60) for _ in range(4)], [prose(rng, 60) for _ in range(9)]
    rows = [(i, f"http://h.org/{i}", "<article>" + "".join(f"<p>{t}</p>" for t in (shared if i < 3 else ["<h2>Introduction</h2>"]) + [own[i]]) + "</article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join((shared if i < 3 else ["Introduction"]) + [own[i]]) for i in range(9)}


def test_what_goes_from_around_an_article():
    def want(heads, sizes, times, pages):
        """The rule, block by block."""
        common = [n >= 3 and n >= pages / 2 for n in times]
        body = [i for i in range(len(sizes)) if i not in heads and not common[i]]
        gone = []
        for i in range(len(sizes)):
            under = [j for j in range(i + 1, len(sizes)) if not any(h in heads for h in range(i + 1, j + 1))] if i in heads else [i]
            outer = body and (i < body[0] or i > body[-1])
            if outer and common[i] and under and all(common[j] and (j < body[0] or j > body[-1]) for j in under):
                gone.append(i)
        return gone if 2 * sum(sizes[i] for i in gone) <= sum(sizes) else []

    rng = random.Random(18)
    for _ in range(2000):
        n = rng.randrange(1, 9)
        case = {i for i in range(n) if rng.random() < 0.3}, [rng.randrange(1, 50) for _ in range(n)], [rng.choice([1, 1, 2, 3, 5, 9]) for _ in range(n)], rng.randrange(1, 12)
        assert html.around_article(*case) == want(*case), case


def test_main_part_beside_articles_is_kept():
    assert html.blocks("<main><h1>T</h1><p>body<article><p>quoted</article><p>end</main><footer>f</footer><p>out") == (["T", "body", "quoted", "end"], True)
    assert html.blocks("<main><p>body</main><article><p>card</article>") == (["body", "card"], True)
    assert html.blocks("<article><p>a<main><p>b</main></article>") == (["a", "b"], True)


def test_boilerplate_of_a_host_without_marked_articles(spark):
    rng = random.Random(11)
    notice = prose(rng, 40)
    bodies = [prose(rng, 90) for _ in range(8)]
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<div>{notice}</div><p>{b}</p>" if i < 6 else f"<p>{b}</p>", "t", 1) for i, b in enumerate(bodies)]
    rows += [(20, "http://h0.org/copy", rows[7][2], "t", 1), (21, "http://h1.org/copy", rows[7][2], "t", 1), (30, None, None, "t", 1), (31, "x", "", "t", 1), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, scope int")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    assert len(got) == len(rows) - 1 and html.main_text(pages).count() == len(rows)
    assert [got[i]["text"] for i in range(1, 8)] == bodies[1:]
    assert got[0]["text"] == bodies[0] and got[21]["text"] == bodies[7] and got[30]["text"] == "" == got[31]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_text(pages.where("false")).count() == 0


def test_short_and_long_boilerplate_goes_from_copies_too(spark):
    rng = random.Random(12)
    menu, notice = "<div>Home</div><div>About us</div>", prose(rng, 40)
    bodies = [prose(rng, 90) for _ in range(6)]
    page = f"{menu}<p>{{}}</p><div>{notice}</div><div>Imprint</div>"
    rows = [(i, f"http://h.org/{i}", page.format(b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://h.org/copy", rows[0][2]), (11, "http://h.org/copy2", rows[0][2]), (12, "http://h.org/near", page.format(bodies[1] + "</p><p>One line more."))]
    rows += [(20, "http://other.org/", page.format(bodies[2]))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == bodies and got[10] == got[11] == bodies[0] and bodies[1] in got[12]
    assert notice not in got[12] and "Home" not in got[12] and got[20].startswith("Home")


def test_boilerplate_inside_marked_articles(spark):
    rng = random.Random(13)
    notice, note = prose(rng, 60), "Sign up for our letter"
    bodies = [prose(rng, 90) for _ in range(7)]
    bodies[5] = bodies[6] = prose(rng, 50)
    rows = [(i, f"http://h.org/{i}", f"<article><p>{b}</p><p>{note}</p><p>No {i} {notice}</p></article>") for i, b in enumerate(bodies[:5])]
    rows += [(i, f"http://h.org/{i}", f"<article><p>{bodies[i]}</p><p>own words {i}</p></article>") for i in (5, 6)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == bodies[:5]
    assert [got[i] for i in (5, 6)] == [f"{bodies[5]} own words {i}" for i in (5, 6)]


def test_pipeline_stages(spark, docs, empty_docs, tmp_path):
    path = tmp_path / "benchmark.parquet"
    text = next(t for t in messy_texts() if t and 40 < len(t.split()) < 90)
    spark.createDataFrame([(0, " ".join(text.split()[5:25]))], "item_id long, text string").write.parquet(str(path))
    now, none = docs, empty_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, now, str(tmp_path)))
        assert after.columns == docs.columns, name
        assert cut(stage(spark, none, str(tmp_path))).count() == 0
        if name == "language":
            assert {r["text"] for r in now.subtract(after).collect()} >= {None, "", "!!! ??"}
        if name == "near_duplicates":
            assert after.count() < now.count() and after.count() == after.select("text").distinct().count()
        if name == "repeated_passages":
            assert after.count() == now.count()
        if name == "decontamination":
            assert now.count() - after.count() in (1, 2)
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_queries_read_whole_tables(spark):
    from cladeframe.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    for name, source in (("op3_sharding", "documents"), ("op6_language", "documents"), ("op8_url_rules", "pages")):
        assert QUERIES[name](spark, folder).count() == table(spark, folder, source).count()
