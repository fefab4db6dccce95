"""The corpus operators against brute force, the libraries or held-out pages, on small rows with nulls, empty and repeated texts."""

import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from docproof.llm import curve_search, html_extraction, jaccard_join, line_dedup, packing, quality, sentencepiece_codec, suffix_dedup, token_counts, url_filters
from docproof.llm.common import path_of

ODD = [None, "", " \t\n", "a", "A", "a b c", "x " * 3000, "xyz" * 300, "ß é\u0301 日本 𝄞\x1f ▁▁  b<|endoftext|>"]


def frame(spark, texts):
    """Documents with a clashing extra column; the last row stands twice."""
    rows = [(i, t, "key") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)


def words(rng, n, of=60):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def test_token_operators(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = list("abcdeth  ▁\n\tésß日本.,'%01İΣ") + ["the", "ing", " " * 5, " " * 17, "'re"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
    tk = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    docs = frame(spark, texts)
    coded = {r[0]: r for r in sentencepiece_codec.encode(docs).collect()}
    counted = {r[0]: r for r in token_counts.count_tokens(docs, limit=20).collect()}
    pieces = defaultdict(list)
    for r in packing.encode_pieces(docs, capacity=64).collect():
        pieces[r.doc_id].append(r)
    for i, t in enumerate(t or "" for t in texts):
        ids = sp.encode(t)
        assert bytes(coded[i].ids) == array("I", [1, *ids, 2]).tobytes() and coded[i].decoded == sp.decode(ids)
        assert (counted[i].n_tokens, counted[i].over_limit, counted[i].n_bytes) == (len(ids), len(ids) > 20, len(t.encode()))
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == array("I", [*tk.encode(t, add_special_tokens=False).ids, 1]).tobytes()
        assert [r.start for r in own] == [64 * k for k in range(len(own))] and all(r.length <= 64 for r in own)


def test_small_tables_of_the_transducer():
    import sentencepiece

    rng, model = random.Random(2), path_of("piece_bpe_32k.model")
    sp, small = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.Counter(model, chunk=7, words=40, states=300)
    texts = ["".join(rng.choice("abt he in▁g日 ") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    assert small.count(texts) == [len(x) for x in sp.encode(texts)]


def test_packing_plan_uses_every_piece():
    rng = random.Random(3)
    for capacity in (10, 50):
        for _ in range(200):
            histogram = {rng.randint(1, capacity): rng.randint(1, 6) for _ in range(rng.randint(0, 8))}
            used = Counter()
            for times, pattern in packing.plan(histogram, capacity):
                assert times > 0 and sum(n * k for n, k in pattern.items()) <= capacity
                for n, k in pattern.items():
                    used[n] += k * times
            assert used == Counter(histogram)
    assert sum(t for t, _ in packing.plan({6: 4, 4: 2, 2: 2, 1: 4}, 10)) == 4  # exact complements fill every sequence


def test_packing_places(spark):
    rows = spark.createDataFrame([(i, 0, i % 7 + 1) for i in range(300)], "doc_id long, piece int, length long")
    got = packing.pack(rows, capacity=10).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 300 and (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 10 and got.sequence_id.nunique() == -(-got.length.sum() // 10)


def test_suffix_dedup(spark, monkeypatch):
    rng, size = random.Random(4), 60
    shared = words(rng, 60)
    texts = ODD + [words(rng, rng.randint(0, 30), 9999) + shared[rng.randint(0, 90) :] + words(rng, 20, 9999) for _ in range(60)]
    texts += texts[-5:]
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    monkeypatch.setattr(suffix_dedup, "GRAM", 16)
    for most in (1000, 3):
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
        got = {r.doc_id: r for r in suffix_dedup.dedup(frame(spark, texts), size=size).collect()}
        for i, d in enumerate(data):
            starts = np.array([k for k in range(len(d) - size + 1) if seen[d[k : k + size]] > 1], int)
            assert [(s.lo, s.hi) for s in got[i].spans] == suffix_dedup.runs(starts, size)
            assert len(got[i].kept) == len(d) - sum(s.hi - s.lo for s in got[i].spans)


def test_url_filters(spark):
    link = '<a href="https://{}/x">x</a>'
    pages = [
        (0, "http://Good.ORG/a?q", link.format("fine.net")), (1, "https://bad.com/de/x#y", link.format("fine.net")), (2, "http://ring.net/1", link.format("bad.com") + link.format("bad.com")),
        (3, "http://fine.net/", None), (4, None, None), (5, "nothing", ""), (6, "http://a.example.org/en/12", ""), (7, "http://org", ""), (8, "x://sub.other.com/fr/", ""), (8, "x://sub.other.com/fr/", ""),
    ]
    rows = url_filters.judge(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 10
    want = {0: ("org/", "allow"), 1: ("com/de/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.org/en/1", "block"), 7: (None, "allow"), 8: ("com/fr/", "allow")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[0].host, got[0].path, got[4].host, got[7].host, got[7].path) == ("good.org", "/a", "", "org", "")
    # Seeds by pages: bad.com and a.example.org one each; good.org one and sub.other.com two. One step each way.
    assert got[2].distrust == pytest.approx(0.15 * 0.85 / 2, abs=1e-6) and got[3].trust == pytest.approx(0.15 * 0.85 / 3, abs=1e-6)


def test_url_filters_reach_along_a_chain(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(46)], "src string, dst string, n long").coalesce(1)
    seeds = spark.createDataFrame([("h0", 1)], "host string, weight long").coalesce(1)
    got = dict(url_filters.propagate(edges, seeds).collect())
    assert len(got) == 47 and got["h46"] == pytest.approx(0.15 * 0.85**46)


def test_curve_search(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[7] = x[200]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 0), (9004, [None] + [1.0] * 15, 0), (9005, [1.0], 0), (None, [1.0] * 16, 0)]
    got = curve_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, entry int")).toPandas()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(d[own.vec_id], own.score, atol=1e-12)
        hit += len(set(own.vec_id) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 300
    assert got[(got.query_id == 200) & (got["rank"] == 1)].vec_id.item() == 7


def test_curve_search_ties(spark):
    """Of 64 vectors at one distance the smallest ids are nearest."""
    ids = random.Random(9).sample(range(1, 65), 64)
    rows = [(0, [1.0] * 64)] + [(i, [1.0 + (a == axis) for a in range(64)]) for axis, i in enumerate(ids)]
    got = curve_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i, i, 1.0) for i in range(1, 11)]


def test_line_dedup(spark):
    line = "One two three four five six seven eight nine."
    long = "A b c d e f g h i j. K l m n o p q r s t."
    texts = ODD + [line + "\nown text", "own\n" + line.upper(), f"Before it. {long} After it.", f"Other words. {long} At last."]
    n = len(ODD)
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got[n].text == texts[n] and got[n + 1].text == "own" and [tuple(s) for s in got[n + 1].removed_spans] == [(3, 4 + len(line))]  # with the separator
    assert got[n + 2].text == texts[n + 2] and "K l m" not in got[n + 3].text and got[n + 3].text.startswith("Other words.") and got[n + 3].text.endswith("At last.")
    assert got[0].text is None and got[1].text == "" and got[3].text == "a"
    for i, r in got.items():
        assert r.text == outside(texts[i], r.removed_spans)


def outside(text, spans):
    """The text without the spans, which must be in order and apart."""
    at, rest = 0, []
    for s in spans:
        assert at <= s.start < s.end <= len(text)
        rest.append(text[at : s.start])
        at = s.end
    return None if text is None else "".join([*rest, text[at:]])


def test_line_dedup_of_equal_rows_and_names(spark):
    """Equal ids rank by text, equal rows in one order: one of them keeps its lines. A column named removed_spans is replaced."""
    line = "One two three four five six seven eight nine."
    rows = [(1, line, "a", 0), (1, line, "b", 0), (1, line + " More.", "c", 0), (None, "x " + line, "d", 0), (2, None, "e", 0), (3, f"{line}\n{line}", "f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, removed_spans int").repartition(3)
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "tag", "removed_spans"]
    kept = {r.tag: r.text for r in got.collect()}
    assert sorted((kept["a"], kept["b"])) == ["", line] and kept["d"] == "x " + line and kept["e"] is None and kept["f"] == ""


def test_line_dedup_against_brute_force(spark):
    """Lines and sentences of eight words or more but the first of each, and passages of 32 words that stand earlier, go; nothing else does."""
    rng = random.Random(18)
    pool = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(rng.choice([3, 9, 12, 40]))) + "." for _ in range(30)]
    texts = ["\n".join(" ".join(rng.sample(pool, rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    units, runs = set(), set()
    for i, text in enumerate(texts):
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        gone = [False] * len(words)
        for a, b, _ in line_dedup.units_of(text):
            key = " ".join(text[a:b].lower().split())
            for k, (_, x, y) in enumerate(words):
                gone[k] |= key in units and a <= x and y <= b
            units.add(key)
        keys = [w for w, _, _ in words]
        mine = [tuple(keys[k : k + 32]) for k in range(len(keys) - 31)]
        must = list(gone)
        for k, r in enumerate(mine):
            if r in runs:
                must[k : k + 32] = [True] * 32
        removed = [any(s.start <= x and y <= s.end for s in got[i].removed_spans) for _, x, y in words]
        assert got[i].text == outside(text, got[i].removed_spans)
        assert all(r or not g for r, g in zip(removed, gone)), i
        assert all(m or not r for m, r in zip(must, removed)), i
        runs.update(mine)


def test_line_dedup_of_passages_inside_sentences(spark):
    rng = random.Random(8)
    short = " ".join(f"{words(rng, 5, 9999)}." for _ in range(10))
    one = words(rng, 50, 9999)
    hosts = [words(rng, 20, 9999) for _ in range(8)]
    texts = [f"{hosts[2 * i]} {p} {hosts[2 * i + 1]}" for i, p in enumerate([short, one, short.upper(), one.replace(" ", "\n", 1)])]
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, texts)).collect()}
    for i in range(4):
        assert got[i].text.split() == (texts[i] if i < 2 else f"{hosts[2 * i]} {hosts[2 * i + 1]}").split()


def test_line_dedup_of_a_sentence_as_a_line_and_inside_one(spark):
    line = "One two three four five six seven eight nine."
    texts = [f"Before it all. {line} After it all.", f"own\n{line}", "x", f"Other words. {line} At last."]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "own", 2: "x", 3: "Other words. At last."}


def test_quality_rules(spark):
    rng = random.Random(6)
    texts = ODD + [words(rng, rng.randint(1, 300), 4) + "\n" + words(rng, 5) + "\n" + words(rng, 5) for _ in range(40)] + ["same line\n" * 5, "#*$ %&|<>"]
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(frame(spark, texts))).collect()}
    for i, t in enumerate(t or "" for t in texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover) if len(w) > 3 else 0)
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>") and r.kept == (r.failed_bits & quality.mask(quality.POLICIES["v1"]) == 0)
    assert quality.keep_good(frame(spark, texts)).columns == ["doc_id", "text", "node"]


def linked_by_brute_force(texts, size, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in enumerate(sets):
        for b in range(a):
            if 100 * len(x & sets[b]) >= percent * len(x | sets[b]) and x:
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return [(len(x), find(i)) for i, x in enumerate(sets)]


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(7)
    common = words(rng, 30, 500)
    texts = list(ODD)
    for _ in range(25):
        base = words(rng, rng.randint(3, 90), 400).split()
        for _ in range(rng.choice([1, 2, 3, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(999)}"
            texts.append(" ".join(copy) + (" " + common if rng.random() < 0.5 else ""))
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    docs = frame(spark, texts)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == linked_by_brute_force(texts, 4, 85)
    kept = {r.doc_id for r in jaccard_join.keep_first(docs.unionByName(docs), size=5, percent=80).collect()}
    assert kept == {i for i, (_, r) in enumerate(linked_by_brute_force(texts, 5, 80)) if i == r}


def test_jaccard_join_between_the_ends_of_a_group(spark):
    """The first set's only partner, 23 of 27 tokens, has a size between the smallest and the largest of its group."""
    middle = list(range(20, 42))
    sets = [[10, *middle, 100], [1, 2, 3, 10, *middle], [1, 2, 3, 10, *middle[:-1]], [1, 2, 3, 4, 10, *middle]]
    rows = [(t, k, len(s), i, min(k, 1), 3 if k else 1) for k, s in enumerate(sets) for i, t in enumerate(s[: len(s) - jaccard_join.needed(len(s), 85) + 1])]
    entries = spark.createDataFrame(rows, "token long, node long, n int, at int, root long, members int")
    assert [(r.node, r.root) for r in jaccard_join.near_groups(entries, 85).collect()] == [(0, 1)]


def test_jaccard_bounds_lose_no_pair():
    """For all sizes and overlaps that link, the first common token lies in the prefixes and the bound of common tokens holds."""
    for p in (80, 85):
        for n in range(1, 80):
            for m in range(1, n + 1):
                need = jaccard_join.enough(n, m, p)
                if need > m:
                    continue
                assert 100 * need >= p * (n + m - need) and need >= jaccard_join.needed(n, p) and need >= jaccard_join.enough(m, m, p)


def test_jaccard_join_of_a_family(spark):
    """Many copies of one text, some too far from all others, and repeated, null and empty rows beside a clashing column."""
    rng = random.Random(17)
    base = words(rng, 80, 9999).split()
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(80), k % 9):
            copy[at] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    texts += [texts[3], None, "", " ".join(base * 200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == linked_by_brute_force(texts, 4, 85)


def test_html_extraction():
    model = html_extraction.Model(html_extraction.training_pages())
    right = total = 0
    for page in html_extraction.training_pages(600)[400:]:
        nodes, labels = html_extraction.parse(page), {}
        for node, p in zip(nodes, model.marginals(nodes)):
            y = labels[id(node)] = {"content": 1, "other": 0, None: labels.get(id(node.parent), 0)}[node.label]
            total += bool(node.text)
            right += bool(node.text) and (p >= 0.5) == y
    assert right >= 0.96 * total  # held-out pages
    page = '<html><head><title>No</title></head><body><nav><ul><li><a href="/">Menu</a></ul></nav><article><h1>Title</h1><p><b>Hel</b>lo &amp; all.<br><p>More  text.<script>var t="</p>";</script></article><div class="ad">Buy it now.</div><footer>&copy; us</footer>'
    assert html_extraction.main_text(model, page) == "Title Hello & all. More text."
    assert html_extraction.main_text(model, None) == html_extraction.main_text(model, "") == ""


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for made in (suffix_dedup.dedup(docs), packing.packed_documents(docs), line_dedup.dedup(docs), sentencepiece_codec.encode(docs), token_counts.count_tokens(docs), jaccard_join.near_duplicates(docs), quality.keep_good(docs)):
        assert made.count() == 0
    assert curve_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
