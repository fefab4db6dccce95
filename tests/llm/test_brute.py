"""Operators without SQL against plain versions of what they compute: enumeration, power iteration, exhaustive packing, the whole pipeline."""

import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter

import pytest

import corpus_pipeline
from docproof.llm import curve_search, html_extraction, packing, quality, token_counts, url_filters
from docproof.llm.common import path_of
from test_operators import linked_by_brute_force, outside


def test_marginals_equal_enumeration():
    """Sum-product on small trees gives what the sum over all labellings gives."""
    model = html_extraction.trained()
    pages = ["<div><p>Some text, here.</p><ul><li><a href=x>Menu</a></li></ul></div><footer>end</footer>", "<article><h1>A title</h1><section><p class=ad>Buy.</p>words</section></article>", "<nav>x</nav><main><div><div><p>Deep.</p></div></div></main>"]
    for page in pages:
        nodes = html_extraction.parse(page)
        at = {id(n): i for i, n in enumerate(nodes)}
        own = [sum(model.unary.get(f, 0.0) for f in html_extraction.features(n)) for n in nodes]
        total, content = 0.0, [0.0] * len(nodes)
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            weight = sum(o for o, y in zip(own, labels) if y)
            weight += sum(model.pair(n)[labels[at[id(n.parent)]]][labels[i]] for i, n in enumerate(nodes) if n.parent is not None)
            total += math.exp(weight)
            content = [c + math.exp(weight) * y for c, y in zip(content, labels)]
        assert model.marginals(nodes) == pytest.approx([c / total for c in content], rel=1e-9)


@pytest.mark.parametrize("depth", [0, 1, 2, 5, 1000])
def test_text_at_any_depth(depth):
    page = f'<nav><ul><li><a href="/">Menu</a></li></ul></nav><article><h1>Title</h1>{"<div>" * depth}<p>Deep text here, a whole sentence.</p>{"</div>" * depth}</article>'
    assert html_extraction.main_text(html_extraction.trained(), page) == "Title Deep text here, a whole sentence."


def test_words_of_classes_do_not_drop_an_article():
    cases = {
        '<article><h1>T here</h1><p class="author">By me</p><div class="message">Some words to you.</div><p>And a text, then.</p></article>': "T here By me Some words to you. And a text, then.",
        "<article><header><h1>Title</h1></header><p>Some text is here, now.</p></article>": "Title Some text is here, now.",
        '<article><h1>T</h1><p><a href="/">All of this is a link, it is.</a></p><p><a href="/">And this too, a link.</a></p></article>': "T All of this is a link, it is. And this too, a link.",
    }
    for page, text in cases.items():
        assert html_extraction.main_text(html_extraction.trained(), page) == text


def test_extraction_in_spark(spark):
    page = "<article><h1>Title</h1><p>A text, of words.</p></article>"
    rows = [(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<article><p>" + "Words and more, here. " * 50_000 + "</p></article>", 0)]
    docs = spark.createDataFrame(rows, "page_id int, url string, html string, text int").repartition(3)
    got = sorted((r.page_id, r.text) for r in html_extraction.extract(docs).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and [g[1] for g in got[:4]] == ["Title A text, of words."] * 2 + ["", ""] and len(got[4][1]) == 50_000 * 22 - 1
    assert html_extraction.extract(docs.limit(0)).count() == 0


def test_page_rank_equals_power_iteration(spark):
    rng = random.Random(21)
    links = Counter((f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40))
    links = {(a, b): n for (a, b), n in links.items() if a != b}
    seeds = {"h1": 2, "h5": 1}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, n long")
    got = dict(url_filters.propagate(edges, spark.createDataFrame(list(seeds.items()), "host string, weight long")).collect())
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    start = {h: w / 3 for h, w in seeds.items()}
    rank = dict(start)
    for _ in range(400):
        new = {h: 0.15 * w for h, w in start.items()}
        for (a, b), n in links.items():
            new[b] = new.get(b, 0.0) + 0.85 * rank.get(a, 0.0) * n / out[a]
        rank = new
    for h, r in rank.items():
        assert got.get(h, 0.0) == pytest.approx(r, abs=2e-5), h


def test_urls_of_odd_rows(spark):
    rows = [(1, "http://A.org/" + "x" * 100_000, "", "r"), (2, "//no", None, "r"), (3, None, None, "r"), (3, None, None, "r")]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id int, url string, html string, rule string"))
    assert sorted((r.page_id, r.host, len(r.path)) for r in got.collect()) == [(1, "a.org", 100_001), (2, "", 0), (3, "", 0), (3, "", 0)]


def test_packing_is_near_the_least_number():
    """On small inputs, against an exhaustive search: exact fills are found, and never a sequence more than one over the least."""

    def least(lengths, capacity):
        best = len(lengths)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                    place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
            place(k + 1, bins + [lengths[k]])

        place(0, [])
        return best

    rng = random.Random(22)
    over = 0
    for _ in range(150):
        capacity = rng.choice([7, 10, 16])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        used = sum(t for t, _ in packing.plan(Counter(lengths), capacity))
        over += used - least(lengths, capacity)
        assert used <= least(lengths, capacity) + 1
    assert over <= 3


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(150)] + [(0, [1.0, 2.0, 0.0])] + [(200 + i, [float(i + 2), 1.0, 1.0]) for i in range(20)]
    got = curve_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert own == [(i, i, 0.0) for i in range(1, 11)]


def test_ledger_policies(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40), (2, " ".join(f"w{i}" for i in range(60))), (3, "x\n" * 60 + " ".join(f"w{i}" for i in range(90))), (4, None)], "doc_id int, body string")
    led = quality.ledger(docs, text_col="body").cache()
    kept = {v: sorted(r.doc_id for r in quality.apply_policy(led, v).where("kept").collect()) for v in quality.POLICIES}
    bits = {r.doc_id: r.failed_bits for r in led.collect()}
    assert kept == {v: sorted(i for i, b in bits.items() if not b & quality.mask(rules)) for v, rules in quality.POLICIES.items()} and kept["base"] == [2, 3]
    for r in quality.ablation(led).collect():
        own, rest = quality.bit(r.rule), quality.mask(quality.POLICIES["v1"])
        assert r.n_failed == sum(bool(b & own) for b in bits.values()) and r.n_failed_alone == sum(b & rest == own for b in bits.values()) and r.n_kept_without == sum(not b & rest & ~own for b in bits.values())


def kept_by_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = len({k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)})
    n, chars = len(w), sum(map(len, w))
    count = lambda of: sum((text or "").count(c) for c in of)
    return not (n < 50 or 100 * repeated > 30 * n or 10 * count("#*$%&|<>") > n or 10 * count("!") > n or 2 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > chars or chars > 12 * n)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Rules, one document of each group, first occurrences of lines and sentences, and packing that uses every token once."""
    from tokenizers import Tokenizer

    rng = random.Random(23)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(8, 12))) + "."
    shared = [sentence() for _ in range(6)]
    texts = []
    for _ in range(40):
        lines = [" ".join(sentence() for _ in range(2)) for _ in range(rng.randint(3, 5))]
        for _ in range(rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        texts.append("\n".join(lines))
    texts += [texts[0], texts[1] + " one more", None, "", "short", "a b " * 60, "!!! " + texts[2].replace(" ", "! "), " ".join(sentence() for _ in range(700))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", len(texts[3]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    good = [i for i, t in enumerate(texts) if kept_by_rules(t)]
    roots = linked_by_brute_force([texts[i] for i in good], 5, 80)
    left = [i for k, i in enumerate(good) if roots[k][1] == k]
    assert len(left) < len(good) < len(texts)
    expected, units = {}, set()
    from docproof.llm.line_dedup import units_of, without

    for i in left:
        spans = []
        for a, b, d in units_of(texts[i]):
            spans += [(a, b)] if d in units else []
            units.add(d)
        expected[i], gone = without(texts[i], spans)
        assert expected[i] == outside(texts[i], [type("S", (), {"start": a, "end": b}) for a, b in gone])
    tokenizer = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    want = {}
    for i, t in expected.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece] = (at, len(part), zlib.crc32(array("I", part).tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    assert any(n == 4096 for _, n, _ in want.values())
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert list(pieces.offset) == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_token_counts_over_chunks(spark):
    """Texts cut into chunks of 50 characters, with and without spaces, count as the library counts them."""
    import sentencepiece

    rng = random.Random(24)
    texts = ["".join(rng.choice(of) for _ in range(rng.randint(0, 400))) for of in ("abcdefghinorst", "abt he in▁g日 ", "the and of  ", "日本語éß", "  a") for _ in range(12)] + [None, "", " " * 300, "x" * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, row string").repartition(4)
    library = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, chunk=50).collect())
    assert got == sorted([(i, len(library.encode(t or ""))) for i, t in enumerate(texts)] + [(0, len(library.encode(texts[0])))])


def test_chunk_maps_compose_in_any_grouping():
    rng = random.Random(25)
    counter = token_counts.Counter(path_of("piece_bpe_32k.model"), chunk=9)
    for _ in range(40):
        maps = [counter.chunk_map(*c) for c in counter.chunks("".join(rng.choice("abt the in  ") for _ in range(80)))]
        while len(maps) > 2:
            k = rng.randrange(len(maps) - 1)
            other = counter.total(maps)
            maps[k : k + 2] = [counter.compose(*maps[k : k + 2])]
            assert counter.total(maps) == other


def test_chunk_maps_from_another_state():
    """A head whose map begins in another state is read again."""
    counter = token_counts.Counter(path_of("piece_bpe_32k.model"), chunk=5)
    text = "internationalisation of the misunderstandings"
    maps = [counter.chunk_map("", c) for _, c in counter.chunks(text)]
    assert counter.total(maps) == counter.count([text])[0]
