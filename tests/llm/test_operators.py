"""The corpus operators against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from glacis.llm import covertree, html, jaccard, langid, toxicity
from glacis.llm.bpe import encode_decode
from glacis.llm.chat import conversations
from glacis.llm.common import components, ranked
from glacis.llm.covertree import near_components
from glacis.llm.exact_dedup import exact_dedup
from glacis.llm.html import extract, main_text
from glacis.llm.jaccard import jaccard_components
from glacis.llm.packing import ByteBPE, best_fit, evolve, islands_of, pack, pack_documents
from glacis.llm.queries import tokenizer
from glacis.llm.sharding import shard

AWKWARD = [(1, "Hello  World"), (2, "hello  world"), (3, None), (4, ""), (5, "ÀÉ ß Σας"), (6, "x " * 3000), (7, "Hello  World"), (7, "Hello  World"), (None, "hello  world"), (None, None), (8, "<|endoftext|> a  b")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'q' as digest", "1 as size", "2 as node", "'en' as lang", "'s' as source")


def empty(spark):
    return documents(spark, [])


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({n for e in links for n in e}, links)
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}


def test_cover_tree(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [v for v in base] + [base[i % 5] + 0.12 * rng.normal(size=8) for i in range(120)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(rows)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (904, []), (905, [-1e300, 1e300] * 4)]
    got = near_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    v = np.array([r[1] for r in rows[:180]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.9
    np.fill_diagonal(link, False)
    want = union_find(range(180), np.argwhere(link))
    assert (got.loc[:179, "n_links"] == link.sum(1)).all() and (got.loc[:179, "component_id"] == [want[i] for i in range(180)]).all()
    assert (got.loc[[900, 901, 902, 903, 904], "n_links"] == 0).all() and got["kept"].loc[[900, 901]].all()
    assert near_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_blocks(spark, monkeypatch):
    """Cells that are split twice, blocks that meet, lengths side by side, null and repeated keys, clashing columns."""
    for name, value in (("BLOCK", 96), ("SAMPLE", 64), ("TOGETHER", 2), ("CENTRES", 4)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    vectors = [*base, *[base[i % 20] + 0.1 * rng.normal(size=8) for i in range(300)], *[base[0] + 1e-3 * rng.normal(size=8) for _ in range(150)], *[base[1]] * 120, *rng.normal(size=(150, 3)), *[2 * base[1]] * 5]
    keys = [None if i in (5, 700) else 41 if i in (40, 42, 720) else i for i in range(len(vectors))]
    rows = [(k, list(map(float, v)), "u", "c") for k, v in zip(keys, vectors)]
    got = near_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid string, cell string")).collect()
    link = np.zeros((len(vectors), len(vectors)), bool)
    for width in (3, 8):
        at = [i for i, v in enumerate(vectors) if len(v) == width]
        m = np.array([vectors[i] for i in at])
        m /= np.linalg.norm(m, axis=1)[:, None]
        link[np.ix_(at, at)] = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    root = union_find(range(len(vectors)), np.argwhere(link))
    least = {}
    for i, r in root.items():
        least[r] = min((k for k in (least.get(r), keys[i]) if k is not None), default=None)
    want = [(keys[i], int(link[i].sum()), least[root[i]] if least[root[i]] is not None else keys[i]) for i in range(len(vectors))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_cover_tree_walk():
    """Two different trees, with weights, against all products."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 6))
    a, b = (covertree.unit(np.concatenate([base + 0.05 * rng.normal(size=base.shape), rng.normal(size=(200, 6)), base[:1] + 1e-4 * rng.normal(size=(40, 6))])) for _ in range(2))
    wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
    ta, tb = (covertree.Tree(p, covertree.build(p), w) for p, w in ((a, wa), (b, wb)))
    link = a @ b.T >= 0.9
    na, nb, (x, y) = covertree.traverse(ta, tb, 0.9, False)
    assert (na == (link @ wb)[ta.order]).all() and (nb == (link.T @ wa)[tb.order]).all()
    both = union_find([("a", i) for i in range(len(a))] + [("b", i) for i in range(len(b))], [(("a", i), ("b", j)) for i, j in np.argwhere(link)])
    mine = union_find(both, [(("a", int(ta.order[i])), ("b", int(tb.order[j]))) for i, j in zip(x, y)])
    assert mine == both
    own = a @ a.T >= 0.9
    np.fill_diagonal(own, False)
    assert (covertree.traverse(ta, ta, 0.9, True)[0] == (own @ wa)[ta.order]).all()


def test_bpe_matches_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    got = encode_decode(documents(spark, AWKWARD), path).toPandas()
    assert len(got) == len(AWKWARD)
    want = [t.encode(x or "", add_special_tokens=False).ids for _, x in AWKWARD]
    assert sorted(np.array(w, "<u4").tobytes() for w in want) == sorted(map(bytes, got["ids"]))
    assert sorted(t.decode(w, skip_special_tokens=False) for w in want) == sorted(got["decoded"])
    assert encode_decode(empty(spark), path).count() == 0


def test_html():
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><script>var a="</p><article>";</script></head><body><header>Top</header><nav><a href=/>Home</a></nav>
      <div class="cookie-notice">We use cookies</div><article><header><h1>One &amp; two</h1></header><p>A <b>bold</b>word.<p>B&nbsp; c<br>d<div class=ad>Buy</div><p>End.</article>
      <div id="comments"><p>First!</p></div><aside>Side</aside><footer>&copy; x</footer>"""
    assert main_text(page) == "One & two A boldword. B c d End."
    assert main_text("") == main_text("<p></p>") == main_text("<!-- x") == ""
    long = "word " * 40
    assert main_text(f"<div><a href=x>menu</a></div><p>{long}</p><p>{long}</p>") == f"{long}{long}".strip()


def test_html_distribution():
    story = [f"Paragraph {i} of the story, which is told in plain blocks and goes on for a while." for i in range(6)]
    told = " ".join(story)
    plain = "".join(f"<p>{s}</p>" for s in story)
    card = "<article class=teaser><h3><a href=/x>Read on</a></h3><p>By Ann.</p></article>"
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(5)) + "</ul>"
    for page in (f"<div>{plain}</div>{card}", f"{card}<div>{plain}</div>", f"<div>{plain[:200]}{plain[200:]}</div>{card}{card}", f"<div>{plain}</div>"):
        assert main_text(f"<body>{page}</body>") == told
    half = "".join(f"<p>{s}</p>" for s in story[:3]) + card + "".join(f"<p>{s}</p>" for s in story[3:])
    assert main_text(half) == told  # a card amid the story doesn't cut it
    assert main_text(f"<p>Short.</p>{links}{plain}{links}<p>Short.</p>") == told  # the distribution decides
    assert main_text(f"<p>{story[0]}</p><p><a href=/>See also</a></p><p>{story[1]}</p>") == f"{story[0]} See also {story[1]}"
    body = f"<h1>T</h1><p>By A.</p><p>x</p>{plain}{links}<p>End.</p>"
    want = f"T By A. x {told} Link 0 Link 1 Link 2 Link 3 Link 4 End."
    assert main_text(f"<p>Short.</p><article>{body}</article><p>Short.</p>") == want
    long = "A long passage outside of the article is text of the page as well, it has more letters than a surge needs to have."
    assert main_text(f"<article>{body}</article><div>{long}</div>") == f"{want} {long}"


def test_html_windows():
    """Surge and dive points against their definition, on random weights."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        w = [int(x) for x in rng.choice([0, 0, 0, 5, 40, 120], rng.integers(0, 25))]
        window, level = int(rng.integers(1, 5)), int(rng.choice([1, 30, 86, 200]))
        total = lambda i: sum(w[k] for k in range(i, i + window) if k < len(w))
        keep = set()
        for i in range(len(w)):  # a line is kept if no zero window lies between it and a surge
            for j in range(len(w)):
                if total(j) >= level and all(total(k) > 0 for k in range(min(i, j), max(i, j) + 1)):
                    keep.add(i)
        got = html.between(w, level, window)
        text = lambda lines: {i for i in lines if w[i]}
        assert text(k for i, j in got for k in range(i, j)) == text(keep) and all(w[i] for i, _ in got)


def test_html_without_names():
    """No article, main or telling names: the windows remove what no list of words can."""
    story = [f"Paragraph {i} of the story, which is told in plain blocks and goes on for a while." for i in range(6)]
    links = lambda k: "".join(f"<div class=q{k}><a href=/{i}>Link {i} of {k}</a></div>" for i in range(6))
    body = f"<div class=x1><h1>A title</h1><p>By Ann.</p>{''.join(f'<p>{s}</p>' for s in story)}<p>End.</p></div>"
    want = " ".join(["A title By Ann.", *story, "End."])
    for page in (f"<div>Brand</div>{links(1)}{body}{links(2)}<div>Terms and so on</div>", f"{links(1)}{body}{links(2)}<p>Call us.</p>{links(3)}<p>Bye.</p>", f"<p>Hello.</p>{links(4)}{body}"):
        assert main_text(page) == want
    for tag in ("article", "main", "section", "td"):  # the tag only weighs
        assert main_text(f"<body>{links(1)}<{tag}>{body}</{tag}>{links(2)}") == want


def test_html_furniture():
    story = "".join(f"<p>Paragraph {i} of the story, which goes on for quite a while and then ends.</p>" for i in range(8))
    told = main_text(story)
    assert told.count("Paragraph") == 8
    for name in ("layout has-sidebar", "no-comments", "with-banner", "sidebar", "page widget", "left-sidebar", "search-results"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", story):
            for wrapper in (f'class="{name}"', f"id='{name}'"):
                assert main_text(f"<body><nav><a href=/>Home</a></nav><div {wrapper}>{inner}</div></body>") == told, (name, inner[:9], wrapper)
    assert main_text(f"<form id=f>{story}</form>") == main_text(f'<div class="comments"><article>{story}</article></div>') == told
    for part in ("<section id=discussion>{}</section>", "<h2 id=search-algorithms>{}</h2>", "<h2 id=related-work>{}</h2>", "<div class=post-header>{}</div>", "<h3 id=comments>{}</h3>"):
        assert main_text(f"<article>{story}{part.format('A part.')}</article>") == f"{told} A part.", part
    for part in ("<div class=ad>{}</div>", "<div id=comments>{}</div>", '<div class="b cookie-bar">{}</div>', "<div class=widget-area>{}</div>", "<ul class=related-posts><li>{}</ul>",
                 "<aside><article>{}</article></aside>", "<div class=related><article>{}</article></div>", "<div role=navigation>{}</div>", "<p hidden>{}</p>", "<footer>{}</footer>", "<div class=site-header>{}</div>"):
        for place in (f"{part.format('Left out. ' * 12)}<article>{story}</article>", f"<article>{story}</article>{part.format('Left out. ' * 12)}"):
            assert main_text(place) == told, part
    comments = "<ol class=comment-list>" + f"<li class=comment><article>{story}</article>" * 3 + "</ol>"
    assert main_text(f"<article>{story}</article>{comments}") == told


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article>x</article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    assert got == {(1, "u"): ("x", 1), (2, None): ("", 0), (None, "v"): ("", 0)}
    long = "word " * 40_000
    rows = [(1, "u", f"<p>{long}</p>", "text", 0), (1, "u", f"<p>{long}</p>", "text", 0), (2, "u", "<p>" * 20_000, "id", 1), (3, "u", "<a " * 20_000, "id", 1)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string, id int")  # names of ours, repeated rows, long pages
    assert sorted((r["page_id"], r["n_chars"]) for r in extract(odd).collect())[:3] == [(1, len(long) - 1), (1, len(long) - 1), (2, 0)]
    assert extract(odd.limit(0)).count() == 0


def test_exact_dedup(spark):
    got = exact_dedup(documents(spark, AWKWARD), counters=4).toPandas()
    lower = lambda t: (t or "").encode().lower()
    groups = collections.defaultdict(list)
    for i, t in AWKWARD:
        groups[hashlib.sha256(lower(t)).hexdigest()].append(i)
    assert len(got) == len(AWKWARD)
    for r in got.itertuples():
        own = groups[r.text_sha256]
        best = max((i for i in own if i is not None), default=None)
        assert r.group_size == len(own) and (r.keep_id == best or best is None) and r.kept == (r.doc_id == best)
    assert exact_dedup(empty(spark)).count() == 0


def test_toxicity_learns_subwords():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(words, 60), *([f"zqxj{rng.choice(list('abc'))}" for _ in range(3)] if bad else [])])
    labels = [i % 4 == 0 for i in range(400)]
    model = toxicity.train([text(b) for b in labels], list(map(int, labels)), 0.25)
    import pyarrow as pa

    p = model.probability(pa.array([text(True).replace("zqxj", "zqxjw") for _ in range(20)] + [text(False) for _ in range(20)] + [""]))
    assert (p[:20] >= 0.3).mean() > 0.9 and (p[20:40] < 0.3).mean() > 0.9 and 0 <= p[40] <= 1


def test_toxicity_step_is_the_gradient():
    """The first step of training against the dense gradient of the loss, by hand."""
    texts = ["good day all", "bad zq zq", "good night", "zq bad day", "fine day"]
    y = np.array([0, 1, 0, 1, 0.0])
    p, width, rate = 0.3, 3, 0.5
    model = toxicity.train(texts, y.astype(int).tolist(), p, width=width, least=0.0, rounds=1, rate=rate, seed=5)
    bags = [toxicity._grams(t) for t in texts]
    used = np.unique(np.concatenate(bags))
    x = np.array([[np.mean(b == u) for u in used] for b in bags])
    x = x / np.sqrt((x**2).sum(0) / len(y))
    norm = np.sqrt((x**2).sum(1)).mean()
    rng = np.random.default_rng(5)
    v, h, bias = rng.normal(0, 0.01, (len(used), width)), rng.normal(0, 1, (width, 2)), np.log([1 - p, p])
    weight = np.where(y == 1, p / y.mean(), (1 - p) / (1 - y.mean())) / len(y)

    def loss(v, h, bias):
        z = x @ v / norm @ h + bias
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return -(weight * z[np.arange(5), y.astype(int)]).sum()

    def slope(at, f, e=1e-6):
        out = np.zeros_like(at)
        for i in np.ndindex(at.shape):
            up, low = at.copy(), at.copy()
            up[i] += e
            low[i] -= e
            out[i] = (f(up) - f(low)) / (2 * e)
        return out

    v2, h2, b2 = v - rate * slope(v, lambda q: loss(q, h, bias)), h - rate * slope(h, lambda q: loss(v, q, bias)), bias - rate * slope(bias, lambda q: loss(v, h, q))
    scale = np.sqrt((np.array([[np.mean(b == u) for u in used] for b in bags]) ** 2).sum(0) / len(y))
    assert np.allclose(model.table[used], (v2 @ (h2[:, 1] - h2[:, 0])) / scale / norm, atol=1e-4) and model.bias == pytest.approx(b2[1] - b2[0], abs=1e-5)


def test_toxicity_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, AWKWARD)
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == len(AWKWARD) and got["score"].between(0, 1).all()
    for r in got.dropna().itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2)
    assert toxicity.toxicity(empty(spark), toxicity.fit(empty(spark), labels.limit(0))).count() == 0


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def jaccard_brute(rows, size, percent):
    own = {i: shingles(t, size) for i, t in rows if i is not None}
    links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    return own, union_find(own, links)


def jaccard_agrees(spark, rows, size, percent, **how):
    got = jaccard_components(documents(spark, rows), words=size, percent=percent, **how).toPandas()
    own, want = jaccard_brute(rows, size, percent)
    named = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert len(got) == len(rows) and {int(i): int(c) for i, c in named["component_id"].items()} == want
    assert {int(i): n for i, n in named["n_shingles"].items()} == {i: len(s) for i, s in own.items()}


@pytest.mark.parametrize("size,percent,bits", [(3, 90, 64), (5, 80, 4)])
def test_jaccard(spark, size, percent, bits):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcd"), 3))
    rows, n = [], 0
    for length in (4, 12, 40, 90):
        for _ in range(4):
            base = [word() for _ in range(length)]
            for k in range(9):
                w = list(base)
                for _ in range(k // 3):
                    w[rng.integers(len(w))] = word()
                rows.append((n, " ".join(w).upper() if k == 4 else " ".join(w)))
                n += 1
    rows += [(900, None), (901, " \n"), (902, "one"), (903, "ONE"), (None, "one"), (904, "solo text"), (905, "long " * 20000), (906, "LONG " * 20000)]
    jaccard_agrees(spark, rows, size, percent, name_bits=bits)  # few bits: names that different sets share
    assert jaccard_components(empty(spark)).count() == 0


def test_jaccard_parities():
    rng = np.random.default_rng(12)
    for _ in range(200):
        every = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(every, rng.integers(1, 300))) for _ in range(2))
        assert jaccard.apart(jaccard.parities(a), jaccard.parities(b)) <= len(np.setxor1d(a, b))
    assert jaccard.apart(jaccard.parities(a), jaccard.parities(a)) == 0


@pytest.mark.parametrize("deep,many", [(3, 2), (2, 16384)])
def test_jaccard_of_shared_passages(spark, deep, many):
    """Texts that share a passage but are no copies, with small groups of copies among them: buckets of many components."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    passages = [list(rng.choice(words, 60)) for _ in range(2)]
    rows = []
    for group in range(30):
        own = [*rng.choice(words, 12), *passages[group % 2], *rng.choice(words, 12)]
        for _ in range(3):
            w = list(own)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    order = rng.permutation(len(rows)).tolist()
    jaccard_agrees(spark, [(order[i], t) for i, t in rows], 5, 80, deep=deep, many=many)


def test_chat_links_quotes(spark):
    rows = [(1, 0, "user", "How are you?\nTell me."), (1, 1, "assistant", "Fine, thanks."), (1, 2, "user", "On Monday, X wrote:\n> how ARE you\n\nI asked first."), (1, 3, "assistant", ">> How are you?\n> Fine, thanks.\nGood."),
            (2, 0, None, None), (2, 1, "user", "> unknown\n"), (None, 0, "user", "a"), (None, 0, "user", "a"), (3, None, "user", "z"), (3, 0, "user", "y")]
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    one = got[got["conv_id"] == 1].set_index("turn").sort_index()
    assert len(got) == len(rows)
    assert one["content"].tolist()[2:] == ["I asked first.", "Good."] and one["parent_turn"].tolist()[1:] == [0, 0, 1] and one["n_linked"].tolist() == [0, 0, 1, 2]
    assert one["depth"].to_dict() == {0: 0, 1: 1, 2: 1, 3: 2} and one["position"].to_dict() == {0: 0, 1: 1, 3: 2, 2: 3}
    assert got[got["conv_id"].isna()]["position"].tolist() == [0, 0]
    assert conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def replies(spark, texts):
    rows = [(c, i, "user", x) for c, conv in enumerate(texts) for i, x in enumerate(conv)]
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().sort_values(["conv_id", "turn"])
    assert len(got) == len(rows)
    return {c: [(None if p != p else int(p), int(n)) for p, n in zip(g["parent_turn"], g["n_linked"])] for c, g in got.groupby("conv_id")}


def test_chat_links_parts_of_messages(spark):
    three = "First line\nand second of one.\n\nParagraph two.\n\nParagraph three,\nits end."
    got = replies(spark, [
        [three, "Other.", "> First line\n> and second of one.\nYes."],  # a paragraph of two lines
        [three, "Other.", "> Paragraph two.\n>\n> Paragraph three,\n> its end.\nYes."],  # two of three paragraphs
        [three, "Other.", "> and second of one.\n>\n> Paragraph two.\nYes."],  # a run of lines over paragraphs
        [three, "Other.", "> First line and second\n> of one.\n>\n> Paragraph\n> two.\nYes."],  # wrapped anew
        [three, "Paragraph three,", "Other.", "> First line\n> [...]\n> Paragraph three,\nYes."],  # with a gap; turn 0 has most of it
        [three, "Paragraph two.", "Paragraph three,\nits end.", "> Paragraph two.\n>\n> Paragraph three,\n> its end.\nYes."],  # the run is of turn 0 only
        [three, "Other.", "> Nothing of it\n> at all\nYes."]])
    for c in range(4):
        assert got[c][2] == (0, 1), c
    assert got[4][3] == (0, 1) and got[5][3] == (0, 1) and got[6][2] == (1, 0)


def test_chat_nested_attributions(spark):
    got = replies(spark, [
        ["A text", "B own\n\nOn Monday A wrote:\n> A text", "C own\n\nOn Tuesday B wrote:\n> B own\n>\n> On Monday A wrote:\n> > A text"],
        ["A text", "B own\n\nAm Montag schrieb A:\n> A text", "Other.", "C own\n\nLe mardi B a écrit :\n> B own\n>\n> Am Montag schrieb A:\n>> A text"],
        ["A text", "B own is long", "Other.", "C own\n\n> B own\n> is long\n> On Monday A wrote:\n> > A text"],  # wrapped anew
        ["On Monday A wrote:\nA text", "Other.", "> On Monday A wrote:\n> A text\nYes."]])
    assert got[0] == [(None, 0), (0, 1), (1, 2)] and got[1] == [(None, 0), (0, 1), (1, 0), (1, 2)] and got[2][3] == (1, 2) and got[3][2] == (0, 1)


def tree_brute(messages):
    """(parent, depth, position, linked) of each message of a conversation given as (own text, quoted text or None)."""
    normal = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    parents, linked = [], []
    for i, (_, quoted) in enumerate(messages):
        found = [j for j in range(i) if quoted and normal(messages[j][0]) == normal(quoted)]
        parents.append(found[-1] if found else i - 1 if i else None)
        linked.append(len(found) > 0)
    kids = collections.defaultdict(list)
    for i, p in enumerate(parents):
        kids[p].append(i)
    depth, position, stack = {}, {}, [(i, 0) for i in reversed(kids[None])]
    while stack:
        i, d = stack.pop()
        depth[i], position[i] = d, len(position)
        stack += [(k, d + 1) for k in reversed(kids[i])]
    return [(parents[i], depth[i], position[i], int(linked[i])) for i in range(len(messages))]


def test_chat_against_brute_force(spark):
    """Random quotes in conversations of many sizes, one of which holds most messages; texts that recur; columns of our own names."""
    rng = np.random.default_rng(14)
    every, rows = {}, []
    for conv, size in enumerate([300, *rng.integers(1, 12, 12).tolist()]):
        messages = []
        for i in range(size):
            own = f"Common text {rng.integers(3)}." if rng.random() < 0.3 else f"Message {i} of {conv} says {rng.integers(1000)}."
            quoted = messages[rng.integers(i)][0] if i and rng.random() < 0.6 else "Never said." if rng.random() < 0.1 else None
            messages.append((own, quoted))
            text = f"On day {i} X wrote:\n> {quoted.upper() if rng.random() < 0.3 else quoted}\n\n{own}" if quoted else own
            rows.append((conv, i, "user", text, 1, 2, "z"))
        every[conv] = tree_brute(messages)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, uid long, rank long, own string")).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        parent, depth, position, linked = every[r.conv_id][r.turn]
        assert (None if r.parent_turn != r.parent_turn else r.parent_turn, r.depth, r.position, r.n_linked) == (parent, depth, position, linked), r


def test_chat_ties_and_long_texts(spark):
    """The same quote twice, two sources of one turn, a very long message and its quote."""
    long = "Word after word. " * 20_000
    rows = [(1, 0, "u", long), (1, 1, "u", "Other."), (1, 2, "u", f"> {long}\nYes."), (2, 0, "u", "Same."), (2, 0, "v", "Same."), (2, 1, "u", "> Same.\n\nA\n> Same.\n\nB")]
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == 6 and (by[1, 2]["parent_turn"], by[1, 2]["n_linked"]) == (0, 1) and (by[2, 1]["parent_turn"], by[2, 1]["n_linked"], by[2, 1]["n_quotes"]) == (0, 2, 2)


def fuse_brute(rows, names):
    """The posterior by plain arithmetic: likelihood, host, site, suffix and declared priors, each less the row's own share."""
    k = range(len(names))
    soft = {}
    for r in rows:
        e = [np.exp(x) for x in r["log"]]
        soft[r["id"]] = [x / sum(e) for x in e] if r["n"] > 0 else [0.0 for _ in k]
    total = lambda some: [sum(soft[r["id"]][j] for r in some) for j in k]
    everywhere, declared = total(rows), {d for d in (r["declared"] for r in rows) if d}
    said = {d: total([r for r in rows if r["declared"] == d]) for d in declared}
    out = {}
    for r in rows:
        own = soft[r["id"]]
        p = [(everywhere[j] + 1 - own[j]) / (sum(everywhere) + len(names)) for j in k]
        for same in (("suffix",), ("site", "suffix"), ("host",)):
            level = total([q for q in rows if all(q[c] == r[c] for c in same)])
            n = max(sum(level[j] - own[j] for j in k), 0)
            p = [(max(level[j] - own[j], 0) + langid.LEAN * p[j]) / (n + langid.LEAN) for j in k]
        score = [r["log"][j] + np.log(p[j]) for j in k]
        if r["declared"]:
            score = [s + np.log((max(said[r["declared"]][j] - own[j], 0) + 0.5) / (sum(v[j] for v in said.values()) + 0.5 * (len(said) + 1))) for s, j in zip(score, k)]
        best = max(k, key=lambda j: score[j])
        sure = 1 / sum(np.exp(s - score[best]) for s in score)
        out[r["id"]] = (names[best] if r["n"] else "und", sure, r["n"] > 0 and sure >= 0.5)
    return out


def test_language_fusion_against_brute_force(spark):
    rng = np.random.default_rng(15)
    names, rows = ["aa", "bb", "cc"], []
    for i in range(80):
        site = f"s{rng.integers(5)}"
        log = rng.normal(0, 3, 3)
        rows.append({"id": i, "host": f"h{rng.integers(2)}.{site}", "site": site, "suffix": f"x{site[1:] in '01'}", "declared": rng.choice(["aa", "bb", "zz", None], p=[0.2, 0.2, 0.1, 0.5]), "n": int(rng.integers(0, 4)), "log": (log - log.max()).tolist()})
    rows += [dict(rows[0], id=100), dict(rows[0], id=101, log=[0.0, 0.0, 0.0], declared=None)]  # a repeat, and a tie
    got = langid.fuse(spark.createDataFrame(rows, "id long, host string, site string, suffix string, declared string, n long, log array<double>"), names).collect()
    want = fuse_brute(rows, names)
    assert len(got) == len(rows)
    for r in got:
        lang, sure, accepted = want[r["id"]]
        assert r["lang"] == lang and r["probability"] == pytest.approx(sure) and r["accepted"] == accepted


def test_language_rows(spark):
    """Repeated rows, columns of our own names, a very long text, a label's bound."""
    docs = spark.createDataFrame([(i, f"the quick fox {i}" if i % 2 else f"der schnelle fuchs {i}", "en" if i % 2 else "de", "s", 1, "x", 0.5) for i in range(30)], "doc_id long, text string, lang string, source string, n int, host string, p double")
    model = langid.fit(docs, rows=5)
    assert model.languages == ["de", "en"]
    odd = docs.limit(4).union(docs.limit(4)).union(spark.createDataFrame([(99, "the quick fox " * 50_000, None, None, 1, "x", 0.5), (98, None, "en", "s", 1, "x", 0.5)], docs.schema))
    got = langid.text_languages(odd, model).toPandas()
    assert len(got) == 10 and got.set_index("doc_id").loc[99, "lang"] == "en" and not got.set_index("doc_id").loc[98, "accepted"]
    assert langid.text_languages(docs.limit(0), model).count() == 0


def test_language(spark):
    words = {"en": "the quick brown fox jumps over lazy dogs with them", "de": "der schnelle braune fuchs springt über faule hunde und", "fr": "le rapide renard brun saute par dessus les chiens où"}
    docs = spark.createDataFrame([(i, f"{w} {w} {i}", k, "s") for k, w in words.items() for i in range(5)], "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    page = lambda k, lang: f"<html lang={lang}><article>{words[k]}</article>"
    pages = spark.createDataFrame([(1, "http://a.example.de/x", page("de", "de")), (2, "http://b.example.fr/", page("fr", "en")), (3, None, None), (4, "::", page("en", "en")), (None, "http://a.example.de/y", page("de", "de"))], "page_id long, url string, html string")
    got = langid.page_languages(pages, model).toPandas()
    by = got.dropna(subset=["page_id"]).set_index("page_id")
    assert by["lang"].to_dict() == {1: "de", 2: "fr", 3: "und", 4: "en"} and not by["accepted"][3] and len(got) == 5
    assert langid.page_languages(pages.limit(0), model).count() == 0


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = AWKWARD + [(100 + i, f"word{i} " * (60 * i)) for i in range(30)]
    got = pack_documents(documents(spark, rows), tokenizer("byte_bpe_50k.json"), capacity=512).toPandas()
    ids = sorted(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, x in rows)
    total = sum(len(x) // 4 for x in ids)
    assert got["length"].sum() == total and got["length"].between(1, 512).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 512
    assert got["sequence_id"].nunique() <= -(-total // 512) + 1
    crc = collections.Counter()
    for x in ids:
        n = len(x) // 4
        at, size = 0, n % 512 or min(n, 512)
        while at < n:
            crc[zlib.crc32(x[4 * at:4 * (at + size)])] += 1
            at, size = at + size, 512
    assert crc == collections.Counter(got["ids_crc32"])
    assert pack_documents(empty(spark), tokenizer("byte_bpe_50k.json")).count() == 0


def test_byte_bpe_chunks():
    tokenizers = pytest.importorskip("tokenizers")
    t, own = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ByteBPE(tokenizer("byte_bpe_50k.json"))
    ranks = ByteBPE(tokenizer("byte_bpe_50k.tiktoken"))
    spaces = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b\ufeff"
    rng = np.random.default_rng(11)
    letters = ["a", "bc", "'s", "12", "é", "?!", "漢", "\u0301", " ", " ", "  ", *spaces]
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(5000)]
    texts += ["a  b   c", " a \n b\t\n\nc ", "it's 12345 ß", "", " ", "a \xa0 \xa0 b", "x" * 5000, "x " * 5000 + "\n", "a <|endoftext|> b", "<|endoftext|><|endoftext|>"]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == np.frombuffer(own.ids(text), "<u4").tolist() == np.frombuffer(ranks.ids(text), "<u4").tolist(), repr(text)


def decreasing(sizes, capacity):
    return len(best_fit(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, capacity))


def test_islands_reach_a_perfect_packing():
    rng = np.random.default_rng(4)
    sizes = [s for _ in range(40) for s in np.diff([0, *sorted(rng.choice(range(1, 100), 3, replace=False)), 100]).tolist()]
    got, made = evolve(sizes, 100, 5)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and len(got) == 40 and all(sum(sizes[i] for i in b) <= 100 for b in got)
    assert made > 0  # the start is random: crossover is what reaches the bound


def test_islands_beat_best_fit_decreasing():
    for seed in range(3):  # three pieces fill a bin, none fits beside others
        rng, sizes = np.random.default_rng(seed), []
        for _ in range(20):
            a = int(rng.integers(380, 490))
            b = int(rng.integers(250, (1000 - a) // 2 + 1))
            sizes += [a, b, 1000 - a - b]
        got, _ = evolve(sizes, 1000, seed)
        assert sorted(i for b in got for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 1000 for b in got)
        assert len(got) < decreasing(sizes, 1000)


def test_elites_migrate(spark):
    rng = np.random.default_rng(6)
    sizes = [int(x) for _ in range(20) for a in [rng.integers(380, 490)] for b in [rng.integers(250, (1000 - a) // 2 + 1)] for x in (a, b, 1000 - a - b)]
    table = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    one = islands_of(table, 1000, epochs=1).select("island", "bins").distinct().collect()
    three = islands_of(table, 1000, epochs=3).select("island", "bins", "bound", "made").distinct().collect()
    assert len(one) == len(three) == 2 and max(r["bins"] for r in three) <= min(r["bins"] for r in one) and {r["bound"] for r in three} == {20}
    placed = pack(table, 1000).join(table, "uid").toPandas()
    assert len(placed) == 60 and placed.groupby("sequence_id")["length"].sum().max() <= 1000 and placed["sequence_id"].nunique() == min(r["bins"] for r in three)


def test_sharding(spark):
    rows = [(i, "same text" if i % 3 == 0 else "x" * (i % 50)) for i in range(600)] + AWKWARD
    got = shard(documents(spark, rows), shards=6).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 6
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert want == collections.Counter(zip(got["size"], got["text_crc32"]))
    short = shard(documents(spark, rows[:600]), shards=6).toPandas().groupby("shard")["size"].sum()
    assert short.max() - short.min() <= 116  # two of the longest rows
    assert shard(empty(spark)).count() == 0


def test_sharding_keeps_groups_and_order(spark):
    """Shards are ranges of the order by hashes; groups below the share stay whole; borders are as near as the histogram promises."""
    rng = np.random.default_rng(16)
    rows = [(i, f"text {rng.integers(150)} " * int(rng.integers(1, 3))) for i in range(3000)] + [(i, "hot") for i in range(5000, 5900)]
    table = documents(spark, rows)
    got = shard(table, shards=5, whole=0.02).toPandas().sort_values(["shard", "slot"])
    keys = table.selectExpr("doc_id", "lpad(hex(xxhash64(text)), 16, '0') k0", "text").toPandas().set_index("doc_id")
    ends = got.assign(k0=keys.loc[got["doc_id"], "k0"].tolist()).groupby("shard")["k0"].agg(["min", "max"])  # hexadecimal digits run like unsigned numbers
    assert (ends["max"].to_numpy()[:-1] <= ends["min"].to_numpy()[1:]).all()
    size, total = got.groupby("shard")["size"].sum(), got["size"].sum()
    assert (size - total / 5).abs().max() <= (0.02 + 0.001) * total / 5 + 200
    shards_of = got.assign(text=keys.loc[got["doc_id"], "text"].tolist()).groupby("text").agg(n=("shard", "nunique"), bytes=("size", "sum"))
    assert (shards_of.loc[shards_of["bytes"] <= 0.02 * total / 5, "n"] == 1).all()
    assert shard(documents(spark, [(1, "a" * 200_000), (1, "a" * 200_000), (None, None)]), shards=3)["size", "shard", "slot"].count() == 3


def test_ranked(spark):
    rng = np.random.default_rng(17)
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 500), rng.integers(0, 9, 500)))]
    got = ranked(spark.createDataFrame(rows, "k long, v long, i long"), "k", "v", "i").orderBy("rank").collect()
    assert [(r["k"], r["v"], r["i"]) for r in got] == sorted(rows) and [r["rank"] for r in got] == list(range(500))


def test_pipeline_rows(spark, tmp_path):
    """Empty tables, repeated rows, null keys and columns of the pipeline's own names pass the stages; all but the last return the columns of documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, key string, cell string, predicted int"
    words = "some plain words that are quite long and are told here in a row without an end"
    rows = [(1, words, "en", "s", 1, 7, "a", "b", 1), (1, words, "en", "s", 1, 7, "a", "b", 1), (2, words.upper(), None, None, 1, None, "a", "b", 1), (None, "other words that nobody has said before, told once", "en", "s", 1, 7, "a", "b", 1), (3, None, "en", "s", 1, 7, "a", "b", 1), (4, "", "en", "s", 1, 7, "a", "b", 1)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/0")
        kept = []
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}/{k + 1}")
            if k < 4:
                assert out.columns == docs.columns
            kept.append(spark.read.parquet(f"{tmp_path}/{name}/{k + 1}").count())
        # no letters: gone; no toxic label: all stay; of three equal texts the largest doc_id; no near copies; two short texts
        assert kept == ([4, 4, 2, 2, 2] if some else [0] * 5)


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [" ".join(word() for _ in range(60)) for _ in range(30)]
    base[3] = base[4] + " " + word()  # near one another, and exact copies of both
    rows = [(i, t) for i, t in enumerate(base)] + [(50 + i, t.upper()) for i, t in enumerate(base[:5])] + [(70 + i, t + " " + word()) for i, t in enumerate(base[5:10])] + [(90, "12 34"), (91, ""), (92, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {i for i, t in rows if t and re.search("[a-z0-9]", t.lower())}
    last = {}
    for i, t in rows:
        if i in kept:
            last[t.lower()] = max(i, last.get(t.lower(), -1))
    kept = set(last.values())
    own = {i: shingles(t, 5) for i, t in rows if i in kept}
    links = [(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    assert set(out["doc_id"]) == set(union_find(own, links).values())
    assert isinstance(out, pd.DataFrame) and len(pipeline.STAGES) == 5
