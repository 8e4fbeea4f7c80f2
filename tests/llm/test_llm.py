"""Training-data operators against brute force, with the edge cases of their docstrings."""

import base64
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import archive, crf, license_scan, linewin, pfair, pq, setsketch, suffix, template, weaksup

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): copies, near copies, nulls, empties, one long text, a repeated row."""
    rng = random.Random(5)
    base = [sentence(rng, 80) + ". " + sentence(rng, 30) + ".\n" + sentence(rng, 25) + "." for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(30):
        words = base[i % 4].split(" ")
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((100 + i, " ".join(words)))
    out += [(200, base[0]), (201, base[0].upper()), (202, None), (203, ""), (204, " \n\t"), (205, "Ab"), (206, "ab"), (207, "éà ü x"),
            (208, sentence(rng, 30_000)), (3, base[3]), (210, base[5] + " " + base[6]), (211, "a b"), (212, "a b")]
    return out


SCHEMA = "doc_id long, text string, items array<string>, n_words int, _spans string, line int, h1 long, sketch string, n_lines string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, ["z"], 1, "s", 2, 3, "k", "n") for i, t in rows], SCHEMA).repartition(3)


def empty(docs):
    return docs.where("doc_id < -1")


def shingles(text, size):
    words = SPACED.findall(low(text))
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def test_near_groups_equal_brute_force(docs, rows):
    for size, percent in ((3, 85), (5, 80)):
        sets = {}
        for i, t in rows:
            sets[i] = shingles(t, size)
        top = {i: i for i in sets}

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        ids = sorted(sets)
        for i in ids:
            for j in ids:
                n = len(sets[i] & sets[j])
                if i < j and n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
        got = setsketch.near_groups(docs, size=size, percent=percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    kept = setsketch.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert setsketch.near_groups(empty(docs)).count() == 0


def test_every_member_of_a_bucket_is_compared(spark, monkeypatch):
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for i in range(40):  # a family of pairwise similarity 0.5, each with one near copy
        own = [f"u{i}x{k}" for k in range(30)]
        texts += [(i, " ".join(shared + own)), (1000 + i, " ".join(shared + own[:-3] + [f"v{i}x{k}" for k in range(3)]))]
    monkeypatch.setattr(setsketch, "band_members", lambda reps: reps.select(F.lit(0).cast("long").alias("band"), "node", "n_shingles"))
    got = setsketch.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i, _ in texts}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    b[:2500] = a[:2500]
    union = np.unique(np.concatenate([a, b]))
    sketch = [setsketch.registers(np.sort(x), np.array([0, len(x)])) for x in (a, b, union)]
    assert (setsketch.merge(sketch[0], sketch[1]) == sketch[2]).all()
    guess = setsketch.joint_estimate(sketch[0], sketch[1], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(guess - 2500 / 3500) < 0.15


def windows_brute(rows, least=20):
    def lines(s):
        found = [(m.start(), m.end()) for m in SPACED.finditer(s)]
        out, cur = [], []
        for k, (a, b) in enumerate(found):
            cur.append(s[a:b])
            nxt = found[k + 1][0] if k + 1 < len(found) else len(s)
            if s[b - 1] in ".!?" or "\n" in s[b:nxt]:
                out.append(cur)
                cur = []
        return out + ([cur] if cur else [])

    seen, want = {}, {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        ls = lines(t or "")
        gone = [False] * len(ls)
        for a in range(len(ls)):
            b = n = 0
            b = a
            while b < len(ls) and (b - a < 3 or n < least):
                n += len(ls[b])
                b += 1
            if b - a < 3 or n < least:
                continue
            key = tuple(w for x in ls[a:b] for w in x)
            if key in seen:
                gone[a:b] = [True] * (b - a)
            seen[key] = True
        want[i] = (len(ls), sum(gone), [w for x, g in zip(ls, gone) if not g for w in x])
    return want


def test_line_windows_equal_brute_force(spark, docs, rows):
    want = windows_brute(rows)
    got = linewin.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert any(w[1] for w in want.values())
    for r in got:
        assert (r.n_lines, r.n_removed, SPACED.findall(r.text or "")) == want[r.doc_id]
    untouched = {i: t for i, t in rows}
    assert all(r.text == untouched[r.doc_id] for r in got if not r.n_removed)
    assert linewin.remove_repeats(empty(docs)).count() == 0


def test_repeated_passages_without_whole_lines(spark):
    rng = random.Random(8)
    texts, kept = [], []
    for i in range(60):
        passage = [f"p{i}x{rng.randrange(10**6)}" for _ in range(51)]
        for k in range(2):
            before, after = ([f"o{i}x{k}x{m}x{j}" for j in range(rng.randrange(5, 40))] for m in range(2))
            texts.append((2 * i + k, " ".join(before + passage + after)))
            kept.append((before, passage, after))
    wide = "".join(chr(0x4E00 + rng.randrange(8000)) + ("\u3002" if k % 17 == 16 else "") for k in range(120))
    texts += [(900, "\u4e01" * 30 + wide), (901, "\u4e02" * 30 + wide), (902, "tail a\nAll rights\nreserved\nby us"), (903, "tail b\nAll rights\nreserved\nby us")]
    got = {r.doc_id: r for r in linewin.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), passages=True).collect()}
    for i, (before, passage, after) in enumerate(kept):
        left = got[i].text.split()
        assert [w for w in left if w not in set(passage)] == before + after
        assert len(left) - len(before + after) == 51 if i % 2 == 0 else len(left) - len(before + after) <= 31
    assert got[900].text == texts[-4][1] and 30 <= len(got[901].text) <= 60
    assert (got[902].text, got[903].text) == ("tail a\nAll rights\nreserved\nby us", "tail b")


def test_decontamination_equals_brute_force(spark, docs, rows):
    text = dict(rows)
    items = [("a", " ".join(text[1].split(" ")[5:40])), ("b", text[208][1000:1400]), ("b", "w1"), ("c", None), ("d", "--- !"), ("e", text[7].upper()),
             ("f", " ".join(text[2].split(" ")[10:22]) + " nowhere"), ("a2", " ".join(text[1].split(" ")[5:40]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)
    for size in (suffix.BLOCK_BYTES, 300):
        got = suffix.contamination(docs, bench, block_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            w = ALNUM.findall(low(text[r.doc_id]))
            hit, found = [False] * len(w), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k:k + n])):
                        found |= own
                        hit[k:k + n] = [True] * n
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), sum(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r.contaminated == (sum(hit) > 0 and 20 * sum(hit) >= len(w))
    clean = suffix.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    best = {(r.item_id, r.item_word): r for r in suffix.longest_matches(docs, bench).collect()}
    assert best["b", 1].n_matched >= 13 and best["b", 1].doc_id == "208"  # word 0 of the item is cut
    none = spark.createDataFrame([], bench.schema)
    assert suffix.contamination(docs, none).where("n_hit > 0").count() == 0
    assert suffix.contamination(empty(docs), bench).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 500)
    places = np.flatnonzero(tokens)
    order = suffix.suffix_array(tokens, places, 500)

    def key(p):
        out = []
        while p < len(tokens) and tokens[p]:
            out.append(tokens[p])
            p += 1
        return out

    keys = [key(p) for p in order]
    assert keys == sorted(keys) and sorted(order) == list(places)


def test_pq_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 24))
    x[200:260] = x[0] + rng.normal(scale=0.22, size=(60, 24))
    x[260:280] = x[5]
    data = [(int(i), [float(np.float32(v)) for v in row], int(i % 3 > 0)) for i, row in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, data[0][1], None),
           (905, data[0][1] + [1.0], 0), (906, [float("inf")] * 24, 0), (907, [], 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pq.near_vectors(df).collect()}
    v = np.array([d[1] for d in data])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([d[2] for d in data])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    top = list(range(300))
    for _ in range(300):
        new = [min([top[i], *(top[j] for j in np.flatnonzero(near[i]))]) for i in range(300)]
        if new == top:
            break
        top = new
    found = sum(got[i].n_links for i in range(300))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(300))
    assert [got[i].component_id for i in range(300)] == top
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd)
    assert pq.near_vectors(df.where("vec_id < 0")).count() == 0


def test_crf_posteriors_equal_enumeration():
    rng = np.random.default_rng(1)
    n, k = 5, 3
    score, trans = rng.normal(size=(n, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32)
    total, mass = np.zeros((n, k)), 0.0
    for path in np.ndindex(*(k,) * n):
        start = np.log(np.exp(trans[:, path[0]]).sum() / k)
        w = np.exp(start + sum(score[i, path[i]] for i in range(n)) + sum(trans[path[i - 1], path[i]] for i in range(1, n)))
        mass += w
        for i in range(n):
            total[i, path[i]] += w
    got = crf.chain_posteriors(score, np.array([0, n]), trans)
    assert np.allclose(got, total / mass, atol=1e-4)
    # blocks carry the state: a long chain equals the plain recursion
    n = 300
    score = rng.normal(size=(n, k)).astype(np.float32)
    t, e = np.exp(trans), np.exp(score)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    a = np.full(k, 1 / k)
    for i in range(n):
        a = (a @ t) * e[i]
        a /= a.sum()
        alpha[i] = a
    for i in range(n - 2, -1, -1):
        beta[i] = t @ (e[i + 1] * beta[i + 1])
        beta[i] /= beta[i].sum()
    want = alpha * beta / (alpha * beta).sum(1, keepdims=True)
    assert np.allclose(crf.chain_posteriors(score, np.array([0, n]), trans), want, atol=1e-3)


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    parts = {"aa": ["tho", "ing", "er", "wh"], "bb": ["eau", "oi", "que", "re"], "cc": ["sch", "ung", "keit", "ein"]}

    def words(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    data = [(i, words(lang, rng.randrange(2, 60)), lang) for i, lang in enumerate(rng.choices(list(parts), k=240))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = crf.fit(df.where("doc_id % 3 <> 1"))
    test = spark.createDataFrame(data + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "ing " * 30_000, None)], df.schema)
    got = {r.doc_id: r for r in crf.predict(test, model).collect()}
    held = [d for d in data if d[0] % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.9
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and 0 <= got[903].score <= 1
    mixed = crf.label_words(model, words("aa", 15) + " " + words("cc", 15))
    assert {x[1] for x in mixed[:12]} == {"aa"} and {x[1] for x in mixed[-12:]} == {"cc"}
    assert crf.fit(df.where("doc_id < 0")) is None
    assert {r.lang_pred for r in crf.predict(test, None).collect()} == {"und"}


def test_label_model_recovers_fire_rates():
    rng = np.random.default_rng(4)
    n, prior = 200_000, 0.1
    y = rng.random(n) < prior
    toxic, clean = np.array([0.6, 0.5, 0.4, 0.3]), np.array([0.01, 0.02, 0.01, 0.02])
    votes = (rng.random((n, 4)) < np.where(y[:, None], toxic, clean)).astype(float)
    model = weaksup.label_model(n, votes.sum(0), votes.T @ votes, prior)
    assert np.allclose(model.fire_toxic, toxic, atol=0.05) and np.allclose(model.fire_clean, clean, atol=0.01)
    double = np.concatenate([votes, votes[:, :1]], axis=1)
    twice = weaksup.label_model(n, double.sum(0), double.T @ double, prior)
    assert twice.weights[0] < model.weights[0]  # a copied voter shares its weight


def test_toxic_documents_that_no_voter_sees_are_not_their_errors():
    rng = np.random.default_rng(6)
    n, seen, prior = 200_000, 0.05, 0.12
    y = rng.random(n) < seen
    toxic = np.array([0.5, 0.4, 0.35, 0.3, 0.3])
    votes = (rng.random((n, 5)) < np.where(y[:, None], toxic, 0)).astype(float)
    votes = np.concatenate([votes, votes.sum(1, keepdims=True) >= 2], axis=1)  # a pattern voter
    model = weaksup.label_model(n, votes.sum(0), votes.T @ votes, prior, 1)
    assert abs(model.prior - seen) < 0.005
    assert np.allclose(model.fire_toxic[:5], toxic, atol=0.05) and model.fire_clean[:5].max() < 0.002
    alone = np.eye(6)[:5]
    assert model.posterior(alone).min() > 0.5
    assert weaksup.seen_share(10, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2), dtype=bool), 0.3) == 0.3


def test_every_stem_votes():
    counts = np.array([9, 8, 7, 6, 5])
    apart = np.diag(counts)
    assert weaksup.groups_of_stems(counts, apart, 3).tolist() == [0, 1, 2, 2, 2]
    assert weaksup.groups_of_stems(counts, apart, 9).tolist() == [0, 1, 2, 3, 4]
    assert weaksup.groups_of_stems(counts[:0], apart[:0, :0], 3).tolist() == []


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(3)
    bad = ["grumblet", "snorkwit", "flibbert"]
    data, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = sentence(rng, rng.randrange(20, 60), 5000).replace("w", "word").split(" ")
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        for _ in range(rng.randrange(3, 7) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        data.append((i, " ".join(words), 0.25))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(data + [(5000, None, 0.0), (5001, "", 0.0), (5002, "hello " * 20_000, 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    detector = weaksup.fit(df, marks, train=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in weaksup.with_score(df, detector).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and max(got[i] for i in (5000, 5001, 5002)) < 0.5
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in labels if i % 5 == 0]) > 0.95
    assert weaksup.fit(df, marks.where("doc_id < 0"), train=F.lit(True)) is None
    assert {r.score for r in weaksup.with_score(df, None).collect()} == {0.0}


def test_main_text(spark):
    page = ('<html><head><title>t</title></head><body class="no-sidebar"><nav><a href="/">Home</a></nav><header>Top</header>'
            '<div class="cookie-notice">We use cookies</div><article><h1>Title {n} &amp; more</h1><p>One  <b>two</b>\n three {n}<p>Four &lt;x&gt;'
            '<script>var p = "</p>";</script><div class="ad">Buy</div></article><section id="comments"><p>Nice</p></section><footer>End</footer>')
    bare = "<body><div>Our shop menu line</div><div>Open daily till late</div><div>Text number {n}</div><div>Thanks for visiting us</div></body>"
    pages = [(n, "http://a.example/x", page.replace("{n}", str(n))) for n in range(5)]
    pages += [(10 + n, "http://B.example:80/y?q", bare.replace("{n}", f"{n} of {n * 7}")) for n in range(6)]
    pages += [(20, None, "<p>alone</p>"), (21, "http://c.example", None), (22, "http://c.example", ""), (23, "nonsense", "a < b & c"),
              (24, "http://c.example", "<p>" + "long " * 50_000 + "</p>"), (10, "http://b.example:80/y?q", bare.replace("{n}", "0 of 0"))]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, template string").repartition(2)
    got = {r.page_id: r for r in template.extract(df).collect()}
    assert len(got) == len({p[0] for p in pages})
    assert all(got[n].text == f"Title {n} & more\nOne two three {n}\nFour <x>" for n in range(5))
    assert all(got[10 + n].text == f"Text number {n} of {n * 7}" for n in range(6))
    assert [got[k].text for k in (20, 21, 22, 23)] == ["alone", "", "", "a < b & c"]
    assert got[24].n_chars == 50_000 * 5 - 1
    assert template.extract(df.where("page_id < 0")).count() == 0


def test_main_text_keeps_what_only_resembles_noise():
    article = ('<article><header><h1 class="article-header">Title</h1></header><p class="ad-hoc">Para</p><div class="related-work">Work</div>'
               '<p id="search">Find</p><p hidden>Aside</p><math>x</math><p class="ad">Buy</p><div class="comments-list">Nice</div></article>')
    assert template.Page(article).main_text() == "Title\nPara\nWork\nFind\nAside\nx"
    assert template.Page('<p>a <b title="x>y</b> c</p><!-- z').main_text() == "a y c"
    assert template.Page("<p>a<!-- b --> c <d").main_text() == "a c <d"


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a \">", "<b>", "<p><i>", "</x>", "<!--", "<![", "<ul><b>x<li></li>", "<a '\"x>"])
def test_main_text_takes_linear_time(piece):
    import time
    template.Page(piece * 100).tokens()
    start = time.perf_counter()
    page = template.Page(piece * (1_000_000 // len(piece)))
    page.tokens()
    page.main_text()
    assert time.perf_counter() - start < 15


def test_main_text_by_classes_alone(spark):
    rng = random.Random(4)
    def words(n):
        return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(99)) for _ in range(n))
    pages, want = [], {}
    for n in range(8):  # no telling names: constant texts and a list of links around the article
        paras = [words(12) for _ in range(rng.randrange(1, 5))]
        links = "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(5))
        pages.append((n, "http://h/1", f'<body><div class="x1">Shop of all</div><div class="x2"><ul>{links}</ul></div><div class="x3"><h2>{paras[0][:9]} {n}</h2>'
                      + "".join(f"<p>{p}</p>" for p in paras) + '</div><div class="x4">Call us</div>'))
        want[n] = "\n".join([f"{paras[0][:9]} {n}", *paras])
    for n in range(10, 16):  # an article element that holds teasers only does not hide the text; articles keep what they repeat
        body = words(40)
        pages.append((n, "http://t/1", f"<body><div class=q>{body}</div><article>More {n}</article><p class=z>End of it</p><i>Bye</i>"))
        want[n] = f"{body}\nMore {n}\n"
        text = words(30)
        pages.append((n + 10, "http://u/1", f"<body><article><h1>{n}</h1><p>{text}</p><p>Tell your friends</p></article>"))
        want[n + 10] = f"{n}\n{text}\nTell your friends"
        pages.append((n + 20, "http://v/1", f"<body><article><h1>Same</h1><p>near copies of one text {n % 7}</p><p>whose other words are equal on all pages</p></article>"))
        want[n + 20] = f"Same\nnear copies of one text {n % 7}\nwhose other words are equal on all pages"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in template.extract(df).collect()}
    assert {k: v.strip() for k, v in want.items()} == got


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for n in range(40):
        host = rng.choice("abc")
        parts = [f"<div class=c{k}>{rng.choice(['s', 't'])}</div>" for k in range(6) if rng.random() < 0.9]
        if host == "c" and rng.random() < 0.3:
            parts.reverse()
        pages.append((n, f"http://{host}/", "<body><h1>x</h1><div class=k>y</div>" + "".join(parts) + "<hr><i>z</i>"))
    df = spark.createDataFrame(pages + [(99, "http://a/", None), (98, "http://d/", "<p>1</p>")], "page_id long, url string, html string")
    got = {(r.host, tuple(r.tokens), r.root) for r in template.templates(df).collect()}
    want = set()
    for host in "abc":
        own = {h: {t[0]: t for t in template.Page(h).tokens()} for _, u, h in pages if u == f"http://{host}/"}
        vectors = {}
        for t in {t for p in own.values() for t in p if t}:
            v = tuple(p[t][2] if t in p else 0 for p in own.values())
            if sum(map(bool, v)) >= 0.6 * len(own):
                vectors.setdefault(v, []).append(t)
        classes = []
        for v, tokens in vectors.items():
            if len(tokens) >= 3:
                on = [p for p in own.values() if tokens[0] in p]
                tokens.sort(key=lambda t: (sum(p[t][3] for p in on) / len(on), t))
                classes.append((len(on), len(tokens), tokens, all(p[a][3] < p[b][3] and p[a][4] < p[b][4] for p in on for a, b in zip(tokens, tokens[1:]))))
        classes.sort(key=lambda c: (-c[0], -c[1]))
        if classes and classes[0][3]:
            want.add((host, tuple(classes[0][2]), True))
            assert len(classes) == 1 or classes[0][:2] != classes[1][:2]
            for _, _, tokens, ordered in classes[1:]:
                slots = {sum(p[r][3] < x for r in classes[0][2]) for p in own.values() if tokens[0] in p and classes[0][2][0] in p
                         for x in (min(p[t][3] for t in tokens), max(p[t][4] for t in tokens))}
                if ordered and len(slots) == 1:
                    want.add((host, tuple(tokens), False))
    assert want and got == want


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "x"), (2, "http://a/2", "é" * 3), (3, None, "x"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "x\r\n\r\nWARC/1.1"),
             (7, "http://a/7", "y" * 500_000), (3, "http://a/3b", "x")]
    df = spark.createDataFrame([(*p, "s") for p in pages], "page_id long, url string, html string, payload string")
    archive.write_archive(df, str(tmp_path / "w"))
    back = archive.read_archive(spark, str(tmp_path / "w"))
    rows = back.select("page_id", "payload", "payload_digest", "payload_bytes", "refers_to", archive.header_field("WARC-Type").alias("kind")).collect()
    assert len(rows) == len(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    for r in rows:
        assert bytes(r.payload) == html[r.page_id] and r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
    assert {(r.page_id, r.kind, r.refers_to) for r in rows} == {
        (1, "revisit", 3), (2, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None), (7, "response", None)}
    for r in archive.records(back).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[size:] == b"\r\n\r\n" and block[:size] in (html[r.page_id], b"")
    assert spark.read.parquet(str(tmp_path / "w" / "blobs")).count() == len(set(html.values()))
    archive.write_archive(df.where("page_id < 0"), str(tmp_path / "e"))
    assert archive.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_pfair_schedule(spark):
    blocks = pfair.blocks_per_period({"a": 5.0, "b": 3.0, "c": 1.0, None: 0.5}, 64)
    slots = pfair.period_slots(blocks, 64)
    assert sum(blocks.values()) == 64 and [s for *_, s in slots] == list(range(64))
    for s, n in blocks.items():
        done = 0
        for source, k, slot in slots:
            assert pfair.release(k, blocks[source], 64) <= slot < pfair.deadline(k, blocks[source], 64)
            done += source == s
            assert abs(done - n * (slot + 1) / 64) < 1
    data = [(i, "a" if i % 3 else ("b" if i % 2 else None), "t") for i in range(2000)] + [(7, "a", "t")]
    df = spark.createDataFrame(data, "doc_id long, source string, block string")
    out = pfair.mix(df, block_rows=16, period=64).collect()
    assert len(out) == len(data)
    assert all(r.release <= r.slot < r.deadline for r in out)
    used = {}
    for r in out:
        used.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in used.values())
    assert len({(r.source, r.block, r.block_place) for r in out}) == len(data)
    full = [r.slot for r in out if r.on_target]
    assert sorted(set(full)) == list(range(max(full) + 1))
    assert pfair.mix(df.where("doc_id < 0")).count() == 0


def test_pfair_stays_at_the_given_weights(spark):
    weights = {"s00": 0.5, "s01": 0.0001, **{f"s{k:02}": 0.4999 / 18 for k in range(2, 20)}}
    total = sum(Fraction(w) for w in weights.values())
    sizes = {s: int(9000 * w) + 1 for s, w in weights.items()}
    data = [(100_000 * k + i, s) for k, s in enumerate(sizes) for i in range(sizes[s])]
    out = pfair.mix(spark.createDataFrame(data, "doc_id long, source string"), weights=weights, block_rows=1).orderBy("slot").collect()
    assert len(out) == len(data)
    assert all(r.release <= r.slot < r.deadline for r in out)
    done = dict.fromkeys(weights, 0)
    reach = [r for r in out if r.on_target]
    assert len(reach) > 8000 and [r.slot for r in reach] == list(range(len(reach)))
    for r in reach:
        done[r.source] += 1
        assert all(abs(n - Fraction(weights[s]) / total * (r.slot + 1)) < 1 for s, n in done.items())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_license_notices(spark):
    texts = ["Released under the MIT License.", "x mit\nLicense; the apache-license MIT LICENSE", "Licensd under the Apache License, Version 2.0!", None, "",
             "permit license", "gnu genral publik license", "a b c " * 20_000 + "Mozilla Public Licence", "nothing here", "é mit license"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.license_report(df).collect()}
    for i, t in enumerate(texts):
        words = ALNUM.findall(low(t))
        places = [(k, lab) for p, lab in license_scan.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in places}))
        for n in r.notices:
            span = " ".join(words[n.word:n.word + n.n_words])
            assert any(lab == n.label and edits(span, phrase) <= k + 2 for lab, phrase, k in license_scan.NOTICES)
    assert [got[i].labels for i in (0, 2, 5, 6, 7, 8)] == ["mit", "apache", "", "gpl", "mpl", ""]
    assert got[7].notices[0].word == 60_000 and got[3].score == 0 and 0 < got[6].score < 1
    assert license_scan.license_report(df.where("doc_id < 0")).count() == 0


def test_notices_before_a_better_one_are_reported():
    notice = license_scan.Notice("mit", "licensed under the mit license", 2)
    text = "licenced under the mit licence x licensed under the mit license licensed undr the mit license y licensed under the mit licence"
    assert [(m.start(), sum(m.fuzzy_counts)) for m in license_scan.matches(notice.pattern, " " + text)] == [
        (text.index("licenced"), 2), (33, 0), (64, 1), (text.index("y lic") + 2, 1)]


def test_every_notice_within_its_bound_is_found(spark):
    """Least edits of each notice over all runs of whole words, by brute force."""
    rng = random.Random(5)
    notices = [("mit", "licensed under the mit license", 2), ("bsd", "bsd 3 clause license", 1), ("mpl", "mozilla public license", 3), ("cc", "by nc", 1)]
    texts = ["unlicensed under the mit licensee", "unlicensed under the mit license", "mozillapublic license", "x" * 3000 + "bsd 3 clause license", "bsd 3 clause license" + "é" * 3000]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices(["a", "mit", "license", "é語"], k=rng.randrange(3))
            w = list(rng.choice(notices)[1])
            for _ in range(rng.randrange(5)):
                i = rng.randrange(len(w))
                w[i] = rng.choice([w[i], "", "é", "語", w[i] + "s", w[i] + " ", "x" + w[i], " "])
            words += "".join(w).split()
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for label, phrase, most in notices:
        found = {r.doc_id: r.notices for r in license_scan.license_report(df, notices=[(label, phrase, most)]).collect()}
        for i, text in enumerate(texts):
            words = ALNUM.findall(low(text))
            spans = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
            least = min(edits(span, phrase) for span in spans if len(span) <= len(phrase) + most) if any(
                len(span) <= len(phrase) + most for span in spans) else most + 1
            assert (min(n.edits for n in found[i]) if found[i] else most + 1) == min(least, most + 1), (text, phrase)
            for n in found[i]:
                assert edits(" ".join(words[n.word:n.word + n.n_words]), phrase) == n.edits
