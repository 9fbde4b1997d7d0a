"""The text operators against brute force, on small fixtures with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import balltree, hmm, hostpaths, langid, lcp, linededup, minhash, packing, pieces, toxicity
from tidemark.llm import queries as registered

SF = "/root/testdata/sf0.001"
random.seed(5)
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(random.choice(WORDS) for _ in range(120))
NEAR = BASE.split()
NEAR[60] = "changed"
CORPUS = [
    (1, BASE), (2, BASE.upper().replace("W", "w")), (3, " ".join(NEAR)), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE two"), (9, " ".join(random.choice(WORDS) for _ in range(4000))),
    (10, "a line that stands in several texts\nanother line of this text here"), (11, "a line that stands in several texts\na lime that stands in several textz\nshort"), (12, BASE), (12, BASE), (None, "no id has this text here at all"),
]


def frame(spark, rows=CORPUS):
    return spark.createDataFrame([(d, t, "en", "web", len(t) if t is not None else None, "x", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, bands int")


def shingles(text):
    words = text.encode().translate(minhash.LOWER if hasattr(minhash, "LOWER") else bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() if text else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {d: root(d) for d in parent}


def test_minhash_like_brute_force(spark):
    more = [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = CORPUS + more
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    sizes = {d: len(shingles(t)) for d, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) and r["n_shingles"] == sizes[r["doc_id"]]


def test_minhash_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(i, BASE.replace("w1 ", f"n{i % 9} ", 1)) for i in range(40)] + [(100, "other words stand here alone")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=90), st.lists(st.tuples(st.integers(0, 90), st.sampled_from(["", "a", "x", "xy"])), max_size=4))
def test_banded_edit_distance(a, changes):
    b = a
    for at, put in changes:
        b = b[:at] + put + b[at + 1 :]
    assert linededup.within(a, b, 2) == (edits(a, b) <= 2)


def brute_lines(rows):
    lines = [(d, i, line) for d, t in rows for i, line in enumerate(linededup.lines_of(t))]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    first = {}
    for x in sorted(lines, key=key):
        if len(x[2]) >= linededup.LEAST_CHARS:
            first.setdefault(x[2], x)
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(first, 2):
        if abs(len(a) - len(b)) <= 2 and linededup.within(a, b):
            links[a].add(b)
            links[b].add(a)
    out = collections.Counter()
    for d, i, line in lines:
        if line not in first:
            out[(d, i, 0, True)] += 1
        else:
            earlier = any(key(first[o]) < key(first[line]) for o in links[line])
            out[(d, i, len(links[line]), first[line][:2] == (d, i) and not earlier)] += 1
    return out


def test_lines_like_brute_force(spark):
    rows = [r for r in CORPUS if r[0] != 12] + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = linededup.judged_lines(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["line_no"], r["n_links"], r["kept"]) for r in got) == brute_lines(rows)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=20), st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "a", "x", "xy"])), max_size=3))
def test_edit_distance_of_short_lines(a, changes):
    b = a
    for at, put in changes:
        b = b[:at] + put + b[at + 1 :]
    assert linededup.within(a, b) == (edits(a, b) <= min(2, min(len(a), len(b)) // 8))


def test_short_lines_have_classes(spark):
    rng = random.Random(3)
    lines = ["Ja.", "No.", "letzte.", "", " ", "x"] + ["".join(rng.choice("ab") for _ in range(rng.randint(6, 18))) for _ in range(120)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(6))) for i in range(60)]
    places = [(i, k, line.strip()) for i, t in rows for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, line in places:
        if line:
            first.setdefault(line, (i, k))
    links = {a: [b for b in first if a != b and edits(a, b) <= min(2, min(len(a), len(b)) // 8)] for a in first}
    want = {(i, k, len(links.get(line, ())), not line or first[line] == (i, k) and all(first[b] > (i, k) for b in links[line])) for i, k, line in places}
    got = linededup.judged_lines(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["line_no"], r["n_links"], r["kept"]) for r in got} == want and len(got) == len(want)


def test_dropped_lines_of_repeated_and_null_ids(spark):
    x, y, z = "a line that is in both rows", "only the first row has this", "something else altogether here"
    rows = [(7, f"{x}\n{y}"), (7, f"{z}\n{x}"), (None, f"{z} 1234567\n{x}"), (None, f"{x}\n{y}!!!!!!!")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.drop_repeated_lines(frame(spark, rows)).collect())
    lines = collections.Counter(line for _, t in got for line in t.split("\n"))
    assert lines == collections.Counter([x, y, z, f"{z} 1234567", f"{y}!!!!!!!"]) and sum(got.values()) == 4
    assert got[None, f"{x}\n{y}!!!!!!!"] == 1  # null ids come first, and of their places the smaller line number


def test_fingerprints(spark):
    got = lcp.fingerprint(frame(spark)).collect()
    assert len(got) == len(CORPUS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[12]["fingerprint"] and by[4]["fingerprint"] == by[5]["fingerprint"] and by[4]["n_chars"] == 0
    assert by[1]["fingerprint"] != by[3]["fingerprint"] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    want = lcp.edited(BASE, CORPUS[1][1])
    assert by[1]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    last = lcp.edited(BASE, CORPUS[-1][1])  # the null id comes first in the order
    assert any(r["edited_sha256"] == hashlib.sha256(last.encode()).hexdigest() for r in got if r["doc_id"] == 12)


def test_phrases_are_locally_consistent():
    long = " ".join(random.choice(WORDS) for _ in range(2000))
    a, shifted, other = lcp.fingerprints([long, "some words put before " + long, " ".join(random.choice("abcdefgh") * 3 for _ in range(2000))])
    assert lcp.likeness(a, a) == 1 and lcp.likeness(a, shifted) > 0.7 and lcp.likeness(a, other) < 0.1


def test_language_gradient_and_accuracy(spark):
    net = langid.BiGru(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = langid.padded([b"abc", b"zebra"])
    y = np.array([0, 1])
    _, grads = net.gradient(x, mask, y)
    for name, at in (("uf", (1, 2)), ("ub", (0, 4)), ("xf", (97, 3)), ("o", (2, 1)), ("bb", (5,))):
        step, values = 1e-4, []
        for sign in (1, -1):
            net.w[name][at] += sign * step
            values.append(net.gradient(x, mask, y)[0])
            net.w[name][at] -= sign * step
        assert (values[0] - values[1]) / (2 * step) == pytest.approx(float(grads[name][at]), rel=0.05, abs=1e-4)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered.queries()["op2_language"](spark, SF).collect()
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) == len(lang) and sum(a == b for a, b in held) >= 0.9 * len(held)
    odd = langid.keep_identified(frame(spark))
    assert odd.columns == frame(spark).columns and not {4, 5, 6} & {r["doc_id"] for r in odd.collect()}


def test_rare_language_takes_nothing_from_the_others(spark):
    rng = random.Random(2)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(i, say("abcde"), "aa") for i in range(150)] + [(200 + i, say("vwxyz"), "vv") for i in range(150)] + [(400, "Ciao.", "it")]
    rows += [(1000 + i, say("abcde"), None) for i in range(20)] + [(2000 + i, say("vwxyz"), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs)
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", langid.predictor(spark, net)("text").alias("p")).collect()}
    assert net.languages == ["aa", "it", "vv"]
    assert all(got[1000 + i]["lang_pred"] == "aa" and got[2000 + i]["lang_pred"] == "vv" for i in range(20))
    assert min(r["score"] for k, r in got.items() if k >= 1000) > 0.9


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)} some text", f"l{i:03}") for i in range(300)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 300


def test_packing(spark):
    rows = packing.pack(frame(spark), max_tokens=50, buckets=3, budget=200).collect()
    tokens = collections.Counter()
    for d, t in CORPUS:
        tokens[d] += len((t or "").split()) + 1
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= r["bucket"]
    assert got == tokens
    places = collections.Counter((r["bucket"], r["batch"], r["slot"]) for r in rows)
    assert max(places.values()) == 1 and all(slot < max(1, 200 // b) for b, _, slot in places)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=9), st.integers(1, 4))
def test_bucket_bounds_are_optimal(counts, k):
    h = np.array([0, *counts])
    lengths = np.flatnonzero(h).tolist()
    cost = lambda bounds: sum(h[n] * next(b for b in bounds if b >= n) for n in lengths)
    got = packing.bucket_bounds(h, k)
    if lengths:
        best = min(cost(sorted({*c, lengths[-1]})) for m in range(k) for c in itertools.combinations(lengths, m))
        assert cost(got) == best and len(got) <= k


@pytest.mark.parametrize("shard", [60, 20, 8192])
def test_top_k_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(balltree, "SHARD_ROWS", shard)
    monkeypatch.setattr(balltree, "FIRST_CELLS", 2)
    monkeypatch.setattr(balltree, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(401)] + [(500, None), (600, []), (700, [float("nan")] * 6), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(900, [1.0, 2.0]), (901, [2.0, 1.0]), (902, [2.0, 1.0]), (1000, [0.0]), (100, [9.0] * 6)]  # other dimensions, one alone, a repeated id
    vectors = balltree.quantised(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, v string"))
    got = collections.defaultdict(list)
    for r in balltree.top_k(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v and None not in v and not any(map(math.isnan, v))]
    want = collections.defaultdict(list)
    for i, q in good:
        if i % 100 == 0:
            want[i] += [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q)]
    # two rows of one id ask together
    twice = {i for i, n in collections.Counter(i for i, _ in good).items() if n > 1}
    assert {i: got[i] for i in got if i not in twice} == {i: sorted(w)[:10] for i, w in want.items() if i not in twice and w}
    assert got[100] == sorted(want[100])[:10]


def test_scores_beyond_64_bits_are_an_error(spark):
    vectors = spark.createDataFrame([(100, [1 << 40] * 4), (1, [1 << 40] * 4)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        balltree.top_k(vectors, vectors.where("vec_id = 100")).collect()


def test_forward_is_exact_and_counts_are_right(spark):
    rng = np.random.default_rng(3)
    rows = lambda *shape: (lambda m: m / m.sum(axis=-1, keepdims=True))(rng.random(shape))
    model = hmm.Hmm(rows(2), rows(2, 2), rows(2, 4))
    seqs = [np.array([0, 3, 1, 2]), np.array([2]), np.array([1, 1, 0])]
    got, counts = model.forward(seqs, backward=True)
    for s, value in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, c in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, c]
            total += p
        assert value == pytest.approx(math.log(total))
    assert counts[0].sum() == pytest.approx(3) and counts[2].sum() == pytest.approx(8) and counts[1].sum() == pytest.approx(5)
    docs = [(1, "A b b", False), (2, None, False), (3, "b c", True), (3, "b c", True), (4, "", False)]
    out = hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")).collect()
    train = collections.Counter(["a", "b", "b", "", "", ""])
    n, v = 6, 3
    for r in out:
        words = [*(next(t for d, t, _ in docs if d == r["doc_id"]) or "").lower().split(), ""]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(words), n, sum(train[w] > 0 for w in words))
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) and r["score"] < 0


PAGE = "<html><head><title>no</title><style>x{}</style></head><body class='home'><nav><a href=/>Menu</a></nav><header>Top</header><div class='layout'><div class='content'><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text of {n}, long enough to win the vote of its host.</p><script>bad()</script><p>Second&nbsp;one</p></div><aside>side</aside><div class='comments'><p>reader says</p></div></div><footer>foot</footer></body></html>"


def test_main_text(spark):
    rows = [(i, "https://a.example/x", PAGE.replace("{n}", str(i))) for i in range(3)] + [(7, None, None), (8, "https://b.example", ""), (9, "https://c.example/", "<p>unclosed text")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in hostpaths.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more First bold text of 1, long enough to win the vote of its host. Second one"
    assert got[1] == (want, len(want)) and got[7] == ("", 0) and got[8] == ("", 0) and got[9][0] == "unclosed text"


def test_main_text_keeps_the_whole_article(spark):
    long, point = "Here is much text of the section, in words. " * 20, "A point of the list that is long. " * 10
    pages = {
        "a": f"<body><nav>Menu</nav><article><h1>Headline</h1><div>Standfirst</div><div><section><p>{long}</p></section></div></article></body>",
        "b": f"<body><nav>Menu</nav><article><p>Before the list</p><ul><li>{point}</li><li>{point}</li></ul><p>After it</p></article></body>",
        "c": f"<body><nav>Menu</nav><div class='page'><h1>Headline</h1><div class='text'><p>{long}</p></div></div></body>",
    }
    rows = [(10 * k + i, f"https://{h}.example/{i}", page) for k, (h, page) in enumerate(pages.items()) for i in range(3)]
    rows.append((99, "https://c.example/other", f"<body><nav>Menu</nav><div class='page'>Teaser</div><div class='story'><p>{long}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in hostpaths.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long, point = long.strip(), point.strip()
    assert got[1] == f"Headline Standfirst {long}" and got[11] == f"Before the list {point} {point} After it" and got[21] == f"Headline {long}"
    assert long in got[99] and "Menu" not in got[99]


def test_pieces_round_trip_and_distribution(spark):
    rows = [*CORPUS, (20, "naïve ▁ text\r\n\x00 日本語  two  spaces "), (21, "▁"), (22, "a" * 500)]
    one, two = ([(r["doc_id"], r["ids"], r["lossless"]) for r in pieces.sampled_pieces(frame(spark, rows)).collect()] for _ in range(2))
    key = lambda x: (x[0] or 0, x[1] or [])
    assert sorted(one, key=key) == sorted(two, key=key) and all(x[2] is not False for x in one)
    decoded = frame(spark, rows).select("doc_id", "text", pieces.sampler()("doc_id", "text").alias("p")).select("text", pieces.decoder()("p.ids").alias("back")).collect()
    assert all(r["text"] == r["back"] for r in decoded)
    vocabulary = pieces.Vocabulary()
    drawn = collections.Counter(tuple(x) for x in pieces.encode(vocabulary, list(range(20_000)), ["the"] * 20_000))
    weights = {}
    for cuts in itertools.product([0, 1], repeat=3):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append("▁the"[at:i])
                at = i
        if all(p in vocabulary.ids for p in parts):
            ids = tuple(vocabulary.ids[p] for p in parts)
            weights[ids] = math.exp(sum(vocabulary.log_weight[i] for i in ids))
    total = sum(weights.values())
    assert set(drawn) <= set(weights)
    for ids, w in weights.items():
        if w / total > 0.02:
            assert drawn[ids] / 20_000 == pytest.approx(w / total, rel=0.1)


def test_toxicity(spark):
    rows = [(i, f"this is a calm text about w{i} and gardens", 0) for i in range(60)] + [(100 + i, f"you utter vermin w{i}", 1) for i in range(40)] + [(200 + i, f"you vile scumbag vermin w{i}", 2) for i in range(40)]
    model = toxicity.train(spark.createDataFrame([*rows, (900, None, 1)], "doc_id long, text string, grade int"))
    assert list(model.thresholds) == sorted(model.thresholds) and (model.weights >= 0).all()
    probe = [(1, "calm gardens"), (2, "vermin"), (3, "vile scumbag vermin"), (4, None), (5, "")]
    out = frame(spark, probe).select("doc_id", toxicity.predictor(spark, model)("text").alias("p")).select("doc_id", "p.*").collect()
    severity = {r["doc_id"]: r["expected_severity"] for r in out}
    assert severity[1] < severity[2] < severity[3] and severity[3] > 1.2 and max(severity[4], severity[5]) < 1
    kept = toxicity.drop_toxic(frame(spark, probe), model)
    assert kept.columns == frame(spark).columns and {r["doc_id"] for r in kept.collect()} >= {1} and 3 not in {r["doc_id"] for r in kept.collect()}


def test_severity_is_independent_of_quality(spark):
    rng = random.Random(1)
    insults = ["vermin", "scumbag", "rotter", "wretch"]
    calm = lambda: [rng.choice(WORDS) for _ in range(30)]
    rows = [(i, " ".join(calm()), 0, 1) for i in range(300)]
    rows += [(1000 + i, " ".join(calm() + rng.sample(insults, 1 + i % 4)), 1, 1) for i in range(40)]
    rows += [(2000 + i, " ".join(calm()), 1, 0) for i in range(15)]  # toxic of low quality, without any insult
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    grade = {r["doc_id"]: r["grade"] for r in toxicity.graded(docs, labels).collect()}
    assert {grade[i] for i in range(300)} == {0} and {grade[2000 + i] for i in range(15)} == {1}
    assert grade[1000] == 1 and grade[1003] == 2
    model = toxicity.train(toxicity.graded(docs, labels))
    flagged = {r["doc_id"] for r in docs.select("doc_id", toxicity.predictor(spark, model)("text").alias("p")).where("p.p_toxic > 0.5").collect()}
    assert flagged == {1000 + i for i in range(40)}


def test_empty_tables(spark):
    empty = frame(spark).limit(0)
    assert minhash.near_duplicates(empty).count() == linededup.judged_lines(empty).count() == lcp.fingerprint(empty).count() == packing.pack(empty).count() == 0
    assert pieces.sampled_pieces(empty).count() == langid.keep_identified(empty).count() == hmm.score_texts(empty.selectExpr("doc_id", "text", "false as held_out")).count() == 0
    assert toxicity.drop_toxic(empty, toxicity.train(empty.selectExpr("doc_id", "text", "0 as grade"))).count() == 0
    vectors = balltree.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert balltree.top_k(vectors, vectors).count() == 0
    assert hostpaths.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
