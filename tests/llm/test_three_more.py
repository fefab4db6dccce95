"""Fill-in-middle, cross-tokenizer alignment and personal data against plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docproof.llm import fill_middle, personal_data, token_alignment
from docproof.llm.common import path_of

ODD = [None, "", " ", "  ", " \t\n", "a", " a", "▁", "x " * 3000, "xyz" * 300, "ß é́ 日本 𝄞\x1f ▁▁  b<|endoftext|><s>"]


def frame(spark, texts):
    """Documents with extra columns, one of them named as an inner one; the last row stands twice."""
    rows = [(i, t, "key", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, key string, block int").repartition(4)


def drawn(rng, parts, n, most):
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middled(doc_id, text):
    """The contract's words, unit by unit."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark):
    rng = random.Random(1)
    texts = ODD + drawn(rng, ["a", "b", "é", " ", "\n", "\x1c", "𝄞", "<P>", "<", "S>", "\x85", "<S", "M>"], 800, 12) + ["word \n" * 200_000]
    docs = frame(spark, texts).selectExpr("if(doc_id = 5, null, doc_id) as doc_id", "text", "key", "block")
    done = fill_middle.transform(docs)
    rows = done.select("*", fill_middle.restored(done.output, done.form).alias("back")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[5 if r.doc_id is None else r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middled(r.doc_id, text)
        assert r.back == (text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0
    own = fill_middle.transform(docs, rate=100, spm=0, sentinels=("[1]", "[2]", "[3]"))
    assert all(r.back == (texts[5 if r.doc_id is None else r.doc_id] or "") for r in own.select("doc_id", fill_middle.restored(own.output, own.form, ("[1]", "[2]", "[3]")).alias("back")).collect())


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
    byte, k = {}, 0
    for b in range(256):
        seen = 33 <= b < 127 or 161 <= b < 173 or b > 173
        byte[chr(b if seen else 256 + k)] = b
        k += not seen
    first = {i: bytes(byte[c] for c in t) for t, i in tk.get_vocab().items() if t != "<|endoftext|>"}
    second = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]}
    return lambda t: tk.encode(t, add_special_tokens=False).ids, sp.encode, first, second


def aligned(texts, sides):
    """Groups and figures by walking through both token lists."""
    encode_a, encode_b, first, second = sides
    each, held = [], Counter()
    for text in texts:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        own = f" {text}".encode()
        if b"".join(first[i] for i in a) != own or b"".join(second[i] for i in b) != own:
            a, b = [], []
        ends = [[sum(len(names[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 400 else np.cumsum([len(names[i]) for i in ids]).tolist() for ids, names in ((a, first), (b, second))]
        shared, parts = set(ends[0]) & set(ends[1]), []
        for ids, at in ((a, ends[0]), (b, ends[1])):
            out, now = [], []
            for i, e in zip(ids, at):
                now.append(i)
                if e in shared:
                    out.append(now)
                    now = []
            parts.append(out)
        groups = list(zip(*parts))
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        held.update(set(links))
        each.append((groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for groups, links in each:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best_links = sum(n for p, n in links.items() if held[p] == best[p[0]])
        yield said, (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best_links, sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "")


def test_token_alignment(spark, sides):
    rng = random.Random(3)
    parts = [*"abcdeth  ▁\n\t\x1c\x85　ésß日本.,'%01İΣ", "the", "ing", " " * 5, " " * 17, "'re", "<s>", "<|endoftext|>", " \n", "𝄞"]
    texts = ODD + drawn(rng, parts, 700, 60) + drawn(rng, [p for p in parts if p != "▁"], 200, 60)
    docs = frame(spark, texts)
    want = list(aligned([*texts, texts[-1]], sides))
    got = token_alignment.align(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *w[1]) for i, w in zip([*range(len(texts)), len(texts) - 1], want))
    shown = {r.doc_id: r.groups for r in token_alignment.groups(docs).collect()}
    assert all(shown[i] == (w[0] or None) for i, w in enumerate(want[:-1]))
    assert token_alignment.align(docs.limit(0)).count() == 0


def test_alignment_of_a_long_text_is_that_of_its_parts(spark, sides):
    """A text of several slices has the groups of the whole, and its links count once for the document."""
    rng = random.Random(4)
    words = ["the", "of", "café", "\n", "x1", "antidisestablishment", " ", "\t", "日本"]
    text = " ".join(rng.choice(words) for _ in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, "the of"), (3, text + " ▁")], "doc_id long, text string")
    assert len(text) > token_alignment.SLICE
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.align(docs).collect()}
    want = [w[1] for w in aligned([text, "the of", text + " ▁"], sides)]
    assert [got[1], got[2], got[3]] == want


def test_elementary_intervals():
    a, b, group = token_alignment.elementary(np.array([1, 4, 6, 9]), np.array([2, 3, 6, 8, 9]))
    assert list(zip(a.tolist(), b.tolist(), group.tolist())) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 2, 0), (3, 3, 1), (3, 4, 1)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x", "é", "𝄞", " ", "-", ".", "+", "+1", "(", "4111111111111111", "12", "255", "256", "1.2.3.4", "0", "7", " 5", "5555 5555 5555 4444", "%", "_", "\n", "a@b.c", "+49 (30) 1234-5678"]
    texts = ODD + ["1.2.3.4" * 5, "4" * 50000, "a" * 100_000, "1-" * 50000, "+1" + "(" * 50000, "a@b.co " * 3000] + drawn(rng, parts, 3000, 30)
    rows = frame(spark, texts).select("doc_id", personal_data.base_spans(personal_data.F.coalesce("text", personal_data.F.lit(""))).alias("base")).collect()
    assert len(rows) == len(texts) + 1 and all([tuple(s) for s in r.base] == personal(texts[r.doc_id]) for r in rows)


def test_added_spans(spark):
    """Keys and passwords are found beside the base kinds; numbers that fail their check, versions and years are not."""
    rng = random.Random(6)
    code = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of"]) for _ in range(8))
    texts, secret = [], {}
    for k in range(490):
        own = {0: "AKIA" + code("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 16), 1: code("0123456789abcdef", 40), 2: "9" + code("0123456789", 15), 3: f"version {rng.randrange(9)}.0", 4: "a.b@mail.example.org", 5: "+1 (555) 555-0" + code("0123456789", 3), 6: code("ABCDEFGHIJKL", 11)}[k % 7]
        if k % 7 == 2 and any(s[1] == 2 for s in personal(own)):
            own = own[:-1] + str((int(own[-1]) + 1) % 10)
        before = words() + {1: ' token = "', 6: " password="}.get(k % 7, " ")
        texts.append(before + own + ('" ' if k % 7 == 1 else " ") + words())
        if k % 7 in (0, 1, 6):
            secret[k] = (len(before), personal_data.ALL.index("secret"), len(before) + len(own))
    rows = personal_data.find(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [tuple(s) for s in r.base] == personal(texts[r.doc_id])
        assert [tuple(s) for s in r.added] == ([secret[r.doc_id]] if r.doc_id in secret else []), texts[r.doc_id]
    assert personal_data.find(frame(spark, ["x"]).limit(0)).count() == 0


def test_posteriors_equal_plain_em(spark):
    """Expectation-maximisation as one expression gives what plain loops give."""
    import math

    p = personal_data
    rng = random.Random(7)
    rows = list({(rng.randrange(3), tuple(rng.choice((0, 1, 2)) for _ in p.LABELERS)): float(rng.randint(1, 50)) for _ in range(40)}.items())
    got = p.reliabilities(spark.createDataFrame([(k, list(v), n) for (k, v), n in rows], "kind int, votes array<int>, n double")).first()
    data = sorted((k, list(v), n) for (k, v), n in rows)
    r = [1 / (1 + math.exp(-2 * sum(x - 1 for x in v))) for _, v, _ in data]

    def fitted():
        shares = []
        for own in (True, False):
            w = [n * (x if own else 1 - x) for (_, _, n), x in zip(data, r)]
            shares.append([[(sum(u for u, (_, votes, _) in zip(w, data) if votes[k] == v) + (p.AGREE if v == (2 if own else 0) else p.OTHER)) / (sum(w) + p.AGREE + 2 * p.OTHER) for v in range(3)] for k in range(len(p.LABELERS))])
        prior = [(sum(n * x for (kind, _, n), x in zip(data, r) if kind == k) + 1) / (sum(n for kind, _, n in data if kind == k) + 2) for k in range(len(p.ALL))]
        return *shares, prior

    for _ in range(p.ROUNDS):
        yes, no, prior = fitted()
        r = [1 / (1 + math.exp(-(math.log(prior[k] / (1 - prior[k])) + sum(math.log(yes[i][x] / no[i][x]) for i, x in enumerate(v))))) for k, v, _ in data]
    assert [q.p for q in got.patterns] == pytest.approx(r, rel=1e-6, abs=1e-12)
    assert [list(x) for x in got.agree] == [pytest.approx(x) for x in fitted()[0]]


SENTENCES = "<p>The first of these is a sentence, and so is what follows it here. Another one stands behind.</p>"


def hints():
    from docproof.llm import html_extraction

    return html_extraction._HINT


@pytest.mark.parametrize("word", hints())
def test_class_words_do_not_drop_parts_of_an_article(word):
    """A name that holds a word of a kind of blocks among others says nothing; one that holds nothing else does."""
    from docproof.llm import html_extraction as h

    model = h.trained()
    page = f'<nav><ul><li><a href="/">Menu</a></li></ul></nav><article><h1>Title</h1>{SENTENCES}<section class="{word}-history"><h2>A part</h2>{SENTENCES * 2}</section>{SENTENCES}</article><footer>&copy; me</footer>'
    text = h.main_text(model, page)
    assert text.count("The first") == 4 and "A part" in text and "Menu" not in text and not text.endswith("me")
    assert h.main_text(model, f'<div class="{word}-x"><h1>Title</h1>{SENTENCES * 6}</div>').count("The first") == 6
    advert = h.main_text(model, f'<article><h1>Title</h1>{SENTENCES}<div class="{word}-box-2"><p>Buy this now, it is good.</p></div>{SENTENCES}</article>')
    assert ("Buy" in advert) == (hints()[word] == "content")


@pytest.mark.parametrize("page, text", [
    ("<p>One single paragraph stands here.</p>", "One single paragraph stands here."), ("Bare text without any markup at all.", "Bare text without any markup at all."), ("<div>A bare div with one short text.</div>", "A bare div with one short text."),
    ("<html><body><p>One. And two, three.</p><p>Second one.</p></body></html>", "One. And two, three. Second one."), ('<div class="ad">Buy.</div>', ""), ('<nav><ul><li><a href="/">x</a></li></ul></nav>', ""),
    ('<article><h1>T</h1><p>Text here, yes.</p><section class="comments"><h2>Comments</h2><div class="comment"><p>A long reader comment, it is. It goes on.</p></div></section></article>', "T Text here, yes."),
])
def test_loose_text(page, text):
    from docproof.llm import html_extraction as h

    assert h.main_text(h.trained(), page) == text


def test_end_tags_without_a_start_are_passed_over():
    from docproof.llm import html_extraction as h

    assert len(h.parse("<div>" * 100_000 + "</span></b>" * 100_000)) == 100_001


def test_two_passes_of_the_pipeline_side_by_side(spark, tmp_path):
    import threading

    import corpus_pipeline

    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n)) + "."
    texts = ["\n".join(line(40) for _ in range(4)) for _ in range(40)]
    texts += [t.replace("w1", "v1", 1) for t in texts[:10]]
    for k in range(2):
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts[: len(texts) - 5 * k])], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
    got = {}

    def go(k):
        got[k] = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / f"{k}")).collect())

    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(set(got[0])) == list(range(40)) and sorted(set(got[1])) == list(range(40))
