"""Extraction, language, toxicity and URL models: exact small cases, brute force and held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

pytest.importorskip("weft.llm")
from weft.llm import html_extract, kn_toxicity, ppm_langid, queries, url_filter  # noqa: E402
from weft.llm.common import FOLD, SYMBOLS, text_views  # noqa: E402

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><p>Site name and motto</p></header>
<nav><ul><li><a href=/x>Home</a></li></ul></nav><div class="ad">Buy now for less, today only</div><article><h1>A &amp; B</h1><p><b>One  two
three.<br><p>Four &#233; five 1 < 2</p><aside>Related things elsewhere</aside><p>End.</p><!-- hidden --><form><p>Your mail</p></form></article>
<div id="comments"><p>I disagree with all of this, says a reader at length</p></div><footer>&copy; all of us, for ever and ever and ever</footer>"""


def brute_region(weights):
    best, found = 0.0, (0, 0)
    for i in range(len(weights)):
        for j in range(i + 1, len(weights) + 1):
            if sum(weights[i:j]) > best + 1e-9:
                best, found = sum(weights[i:j]), (i, j)
    return best, found


def test_region_scan_is_the_best_of_all_runs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        w = list(rng.integers(-4, 4, rng.integers(0, 14)).astype(float))
        i, j = html_extract.best_region(w)
        assert sum(w[i:j]) == brute_region(w)[0]


def model():
    return html_extract.train([html_extract.label_by_markup(PAGE.replace("Four", f"Word {i}")) for i in range(5)])


def test_extraction():
    m = model()
    assert html_extract.extract(PAGE, m) == "A & B\n\nOne two three.\n\nFour é five 1 < 2\n\nEnd."
    assert html_extract.extract(None, m) == "" and html_extract.extract("", m) == "" and html_extract.extract("<nav>menu only</nav>", m) == ""
    assert html_extract.extract("plain words", m) == "plain words"
    assert html_extract.extract("<p>a<!-- open", m) == "a" and html_extract.extract("<p>a<script>never closed", m) == "a"
    assert len(html_extract.extract("<p>" + "word " * 200_000, m)) == 5 * 200_000 - 1
    assert html_extract.extract("<!-- " * 50_000 + "x", m) == ""


def test_pages_of_the_table(spark, sf_dir):
    import html
    import re

    got = {r.page_id: r for r in queries.op1_html_extraction(spark, sf_dir).collect()}
    rows = queries.table(spark, sf_dir, "pages").collect()
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        a = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", a)]
        same += got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert same >= 0.98 * len(rows)
    edge = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.url or "", r.text) for r in html_extract.extract_pages(edge, model()).collect()) == [("", ""), ("u", "a")]


def plain_ppm(counts, history, symbol):
    """Method C without exclusion, straight from counts by context."""
    p = 1.0 / 256
    for k in range(ppm_langid.ORDER + 1):
        c = counts.get(tuple(history[len(history) - k:]), {})
        total, kinds = sum(c.values()), len(c)
        if total:
            p = c[symbol] / (total + kinds) if symbol in c else kinds / (total + kinds) * p
    return p


def test_code_lengths_against_plain_ppm():
    texts = {"x": ["abab abba cab", "bab"], "y": ["zzz yz é", "yz"]}
    m = ppm_langid.train(texts)
    probe = ["abé z", "", "q", "Ab\u00e8", "yz abab"]
    raw = [t.encode() for t in probe]
    joined, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for block in (3, 1 << 20):
        got = ppm_langid.code_lengths(m, joined, offsets, block)
        for j, language in enumerate(m.languages):
            counts = {}
            for t in texts[language]:
                s = [32] * ppm_langid.ORDER + list(t.encode())
                for i in range(ppm_langid.ORDER, len(s)):
                    for k in range(ppm_langid.ORDER + 1):
                        c = counts.setdefault(tuple(s[i - k:i]), {})
                        c[s[i]] = c.get(s[i], 0) + 1
            for i, r in enumerate(raw):
                s = [32] * ppm_langid.ORDER + list(r)
                want = -sum(math.log2(plain_ppm(counts, s[:n], s[n])) for n in range(ppm_langid.ORDER, len(s)))
                assert abs(got[i, j] - want) < 1e-3


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    m = ppm_langid.train({"en": ["the cat sat on the mat"] * 3, "de": ["der hund und die katze"] * 3})
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the cat"), (4, "the cat")], "doc_id long, text string")
    out = sorted((r.doc_id, r.lang_pred) for r in ppm_langid.identify(edge, m).collect())
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert [r.doc_id for r in ppm_langid.accepted_documents(edge.withColumnRenamed("x", "x"), m).collect()] == [4, 4]
    assert ppm_langid.identify(edge, ppm_langid.train({})).where("lang_pred = 'und'").count() == 5
    assert ppm_langid.identify(edge.where("false"), m).count() == 0
    clash = edge.withColumn("row", edge.doc_id).withColumn("t", edge.text).withColumn("score", edge.doc_id)
    assert ppm_langid.accepted_documents(clash, m).columns == clash.columns


def test_samples_are_counted_whole_in_tasks(spark):
    from pyspark.sql import functions as F

    rows = [(1, "ab" * 3000 + "zq", "x"), (2, "é b", "y"), (3, None, "y"), (4, "", "x"), (5, "left out", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = ppm_langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    b = ppm_langid.train({"x": ["ab" * 3000 + "zq"], "y": ["é b"]})
    raw = "abz zq é".encode()
    probe = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    assert a.languages == b.languages == ["x", "y"] and np.allclose(ppm_langid.code_lengths(a, *probe), ppm_langid.code_lengths(b, *probe))
    text = np.frombuffer(b"abcabd" * 9, np.uint8)
    assert ppm_langid.gram_counts(text, np.array([0, 54]), block=5) == ppm_langid.gram_counts(text, np.array([0, 54]))


def test_toxicity_held_out(spark):
    words = ["stone", "river", "light", "cloud", "green", "paper", "house", "seven"]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        t = [words[k] for k in rng.integers(0, 8, 60)]
        toxic = i % 6 == 0
        if toxic:
            t[int(rng.integers(60))] = "vilescum"
            t[int(rng.integers(60))] = "vilescums"
        rows.append((i, " ".join(t), int(toxic) if i % 2 == 0 or toxic else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    from pyspark.sql import functions as F

    train = docs.withColumn("label", F.when(F.col("doc_id") % 3 != 1, F.col("toxic")))
    m = kn_toxicity.fit(train, F.col("label"), F.xxhash64("doc_id", F.lit(9)) % 5 == 0)
    got = {r.doc_id: r for r in kn_toxicity.score(docs, m).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    edge = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "vilescum " * 50_000, 5.0)], "doc_id long, text string, score double")
    scores = {r.doc_id: r.score for r in kn_toxicity.score(edge, m).collect()}
    assert 0 <= scores[1] == scores[2] < 0.7 <= scores[3] <= 1
    assert kn_toxicity.score(edge.where("false"), m).count() == 0
    odd = edge.withColumn("id", F.lit(None).cast("long")).withColumn("f", F.lit(1)).withColumn("t", F.lit(2))
    assert kn_toxicity.score(odd, m, "id").where("id IS NULL AND score IS NOT NULL").count() == 3
    nothing = kn_toxicity.fit(docs.where("false"), F.col("toxic"), F.lit(True))
    assert kn_toxicity.score(edge, nothing).where("predicted = 0 AND score < 1e-9").count() == 3
    none = kn_toxicity.fit(docs.withColumn("label", F.lit(None).cast("int")), F.col("label"), F.lit(False))
    assert kn_toxicity.score(docs.limit(3), none).where("predicted = 0").count() == 3


def plain_kneser_ney(texts):
    """Plain interpolated Kneser-Ney over (folded text, class) pairs: shared p(symbols), and p(gram, class)."""
    from collections import Counter, defaultdict

    n = kn_toxicity.CONTEXT
    by_class, level = defaultdict(Counter), set()
    for text, kind in texts:
        symbols = [int(FOLD[b]) for b in text.encode()]
        for i, x in enumerate(symbols):
            if x:
                begin = max([j + 1 for j in range(i) if symbols[j] == 0], default=0)
                gram = tuple(([0] * n + symbols[begin:i + 1])[-n - 1:])
                by_class[kind][gram] += 1
                level.add(gram)
    kinds = {}
    for k in range(n, 0, -1):
        kinds[k] = Counter(g[1:] for g in level)
        level = set(kinds[k])

    def discount(counts):
        one, two = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return one / (one + 2 * two) if one and two else 0.75
    d = {k: discount(kinds[k].values()) for k in kinds}

    def shared(g):
        k = len(g)
        if not k:
            return 1 / SYMBOLS
        after = [c for x, c in kinds[k].items() if x[:-1] == g[:-1]]
        if not after:
            return shared(g[1:])
        return max(kinds[k][g] - d[k], 0) / sum(after) + d[k] * len(after) / sum(after) * shared(g[1:])

    def p(g, kind):
        after = [c for x, c in by_class[kind].items() if x[:-1] == g[:-1]]
        if not after:
            return shared(g[1:])
        dc = discount(by_class[kind].values())
        return max(by_class[kind][g] - dc, 0) / sum(after) + dc * len(after) / sum(after) * shared(g[1:])
    return by_class, shared, p


def test_plain_kneser_ney_agrees_on_every_gram_and_sums_to_one(spark):
    from pyspark.sql import functions as F

    texts = [("abc abd abc xbc aaa", 0), ("abc vile vile abd", 2), ("abd xbc aaa abc vila", 1), ("bcd bcd", 0), ("aaa abc", 1), ("vile xb", 2)]
    by_class, shared, p = plain_kneser_ney(texts)
    docs = spark.createDataFrame([(t, k) for t, k in texts], "text string, kind int")
    counts = kn_toxicity.gram_counts(docs, F.col("text"), F.col("kind"))
    seen, unseen = kn_toxicity.train_tables(counts)
    coded = lambda g: sum(x * SYMBOLS ** (len(g) - 1 - i) for i, x in enumerate(g))
    got = {r.g: r["diff"] for r in seen.collect()}
    known = set(by_class[1]) | set(by_class[2])
    assert got.keys() == {coded(g) for g in known}
    assert all(abs(got[coded(g)] - math.log(p(g, 2) / p(g, 1))) < 1e-5 for g in known)
    contexts = {r.c: r["diff"] for r in unseen.collect()}
    free = next(x for x in range(SYMBOLS) if all(g[-1] != x for g in known))
    assert all(abs(contexts[coded(g[:-1])] - math.log(p((*g[:-1], free), 2) / p((*g[:-1], free), 1))) < 1e-5 for g in known)
    for g in known:
        for kind in (1, 2):
            assert abs(sum(p((*g[:-1], x), kind) for x in range(SYMBOLS)) - 1) < 1e-9


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    assert len(got) == queries.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in queries.table(spark, sf, "labels").where("toxic IS NOT NULL").collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [x for x, t in held if t == 0], [x for x, t in held if t == 1]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) >= 0.85 * len(good) * len(bad)


def test_toxicity_keeps_rare_grams_beyond_the_broadcast(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    spelled = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(1, 14)))
    common = [spelled() for _ in range(20)]
    rows = []
    for i in range(120):
        t = [common[k] for k in rng.integers(0, 20, 12)] + [spelled() for _ in range(6)] + ["vilescum"] * (i % 5 == 0)
        rows.append((i, " ".join(t), None if i % 7 == 0 else int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + rows[:2] + [(500, None, None), (501, " ", 0)], "doc_id long, text string, toxic int")
    calibrate = F.col("doc_id") % 3 == 0
    counts = kn_toxicity.gram_counts(docs, F.col("text"), F.when(F.col("toxic").isNull() | calibrate, 0).otherwise(F.col("toxic") + 1))
    got = counts.toPandas()
    seen, unseen = kn_toxicity.train(got.gram.to_numpy(), got.n1.to_numpy(float), got.n2.to_numpy(float))
    known, contexts = (t.toPandas() for t in kn_toxicity.train_tables(counts))
    assert len(known) == ((got.n1 + got.n2) > 0).sum() == seen.get(known.g.to_numpy())[1].sum()
    assert np.allclose(seen.get(known.g.to_numpy())[0], known["diff"], atol=1e-5)
    assert np.allclose(unseen.get(contexts.c.to_numpy())[0], contexts["diff"], atol=1e-5)
    probe = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "vilescums qqqqq " + common[0])], "doc_id long, text string"))
    scores = []
    for most in (10**6, 40, 0):
        m = kn_toxicity.fit(docs, F.col("toxic"), calibrate, max_broadcast=most)
        assert (m.tables is None) == (most == 10**6)
        scores.append(sorted((r.doc_id, r.score) for r in kn_toxicity.score(probe, m).collect()))
    assert len(scores[0]) == 125
    for other in scores[1:]:
        assert [i for i, _ in other] == [i for i, _ in scores[0]] and np.allclose([x for _, x in other], [x for _, x in scores[0]], atol=1e-6)


def test_grams_by_text():
    import pyarrow as pa

    for _, _, raw, offsets in text_views(pa.array(["ab c", None, "ab"]), 3):
        g, word, firsts = kn_toxicity.grams(raw, offsets)
        assert len(firsts) == len(offsets) and len(g) == len(word) == int((FOLD[raw] > 0).sum())


def test_word_heads_and_tails_hold_every_gram():
    import pyarrow as pa

    odd = ["", None, "ab c", "ab", " x", "abcdefgh abcdefghi abcdefghij", "\t\n ", "é" * 30 + " " + "ß", "a" * 5000, "no end", "begins at once ", "1-2,3 (a)", "漢字かな交じり文" * 40, None]
    for size in (1, 30, 1 << 20):
        for _, _, raw, offsets in text_views(pa.array(odd * 3), size):
            g, word, firsts = kn_toxicity.grams(raw, offsets)
            words = kn_toxicity.words_of(raw, offsets)
            assert firsts.tolist() == words.firsts.tolist() and len(words.heads) == firsts[-1]
            h, of = kn_toxicity.head_grams(words.heads)
            assert sorted(zip(word.tolist(), g.tolist())) == sorted([*zip(of.tolist(), h.tolist()), *zip(words.tail_word.tolist(), words.tail.tolist())])


def test_toxicity_looks_up_a_repeated_word_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"stone river lightning stone vilescum " * 4000, b"", b"river incomprehensible river"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    g, word, firsts = kn_toxicity.grams(raw, offsets)
    known = np.unique(g)[::2]
    seen = kn_toxicity.HashTable(known, rng.normal(size=len(known)).astype(np.float32))
    contexts = np.unique(g // SYMBOLS)
    unseen = kn_toxicity.HashTable(contexts, rng.normal(size=len(contexts)).astype(np.float32))
    value, found = seen.get(g)
    value[~found] = unseen.get(g[~found] // SYMBOLS)[0]
    plain = kn_toxicity.weighed(np.bincount(word, value, firsts[-1]), 0.01)
    asked = []
    get = kn_toxicity.HashTable.get
    monkeypatch.setattr(kn_toxicity.HashTable, "get", lambda self, keys: asked.append(len(keys)) or get(self, keys))
    got = kn_toxicity.differences(kn_toxicity.ToxicityModel(seen, unseen, (0.01,), 0.0, 0.0), raw, offsets)[:, 0]
    assert np.allclose(got, [plain[:firsts[1]].mean(), 0, plain[firsts[2]:].mean()], rtol=1e-12)
    assert sum(asked) < len(g) // 10


def plain_rule(url):
    from urllib.parse import urlsplit  # noqa: F401 - the contract is simpler than a URL parser
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules_and_verdicts(spark, sf_dir):
    urls = [r.url for r in queries.table(spark, sf_dir, "pages").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net?/en/", "http://xexample.com/de/", "http://a.example.com/de/x", "ftp://b.org/fr/#a", "http://b.org/fr", "x://Ünet/", "http://a.net:80/", "http://a.net/b?c://d"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[:3])], "page_id long, url string, difference int")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) + 3
    for i, u in enumerate(urls + urls[:3]):
        host, path, (rule, verdict) = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_models_separate_what_they_learned(spark):
    rows = [(i, f"http://www.good{i % 40}.example.net/en/story-{i}") for i in range(300)] + [(1000 + i, f"http://spam{i % 40}.example.com/de/casino-{i}") for i in range(300)]
    rows += [(5000, "http://www.good7.info/en/story-x"), (5001, "http://spam3.biz/de/casino-y")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def test_unseen_url_grams_back_off_to_shorter_contexts(spark):
    from collections import Counter

    known = [("good.net/en/story-one", True), ("good.net/en/story-two", True), ("spam.com/casino", False), ("spams.com/casinos", False)]
    other = "xstoryx.org/qcasq"
    order = url_filter.ORDER
    counts = {kind: Counter() for kind in (True, False)}
    contexts = {kind: Counter() for kind in (True, False)}

    def five(body):
        t = "^" * (order - 1) + body + "$"
        return [t[i:i + order] for i in range(len(t) - order + 1)]
    for body, kind in known:
        for g in five(body):
            for k in range(1, order + 1):
                counts[kind][g[-k:]] += 1
                contexts[kind][k, g[-k:-1]] += 1

    def p(g, kind):
        out = 1 / url_filter.ALPHABET
        for k in range(1, order + 1):
            out = (counts[kind][g[-k:]] + url_filter.PRIOR * out) / (contexts[kind][k, g[-k:-1]] + url_filter.PRIOR)
        return out
    urls = spark.createDataFrame(known + [(other, None)], "body string, accepted boolean")
    got = {r.g: r["diff"] for r in url_filter.train(urls).collect()}
    want = {g: math.log(p(g, True) / p(g, False)) for body in [b for b, _ in known] + [other] for g in five(body)}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    assert sum(g not in {x for b, _ in known for x in five(b)} and abs(want[g]) > 0.1 for g in five(other)) > 3


def test_marks_hide_no_wrappers_and_end_tags_are_implied():
    m, story = model(), "<p>A long story about a river and the town beside it.</p>" * 3
    told = "\n\n".join(["A long story about a river and the town beside it."] * 3)
    for page in ('<body class="has-sidebar">%s</body>', '<body><div id="page" class="no-comments header-fixed">%s</div></body>', '<article class="social">%s</article>',
                 "<body><form id=aspnet>%s</form></body>", "<p class=notice>Sale now<div>%s</div>", "<ul><li class=share>Share it<li>x</ul>%s"):
        assert told in html_extract.extract(page % story, m), page
    assert "Sale" not in html_extract.extract("<p class=notice>Sale now<div>" + story + "</div>", m)
    assert told in html_extract.extract("<nav>Home<div>" + story + "</div>", m)
    assert html_extract._hidden(list(html_extract.tokens("<div class=ad>x<b>y</div>z z z z")), m) == [True] * 5 + [False]


STORY = "The river rose again in the night and the town beside it woke to water."
ODD = {
    '<body class="has-sidebar"><article><h1>T</h1><p>%s</p></article></body>': "T\n\n" + STORY,
    '<body><form id="f"><article><h1>T</h1><p>%s</p></article></form></body>': "T\n\n" + STORY,
    '<body><article><div class="article-header"><h1>T</h1></div><p>%s</p></article></body>': "T\n\n" + STORY,
    '<body><article><div id="share-price"><p>%s</p></div></article></body>': STORY,
    '<body><article><p>%s</p><div class="share"><a href=x>Post</a> <a href=y>Mail</a></div><p>End.</p></article></body>': STORY + "\n\nEnd.",
    '<body><article><aside>Also<p>%s</p></article></body>': "Also\n\n" + STORY,
    '<body><article><p><img alt="a > b" src=x>%s</p></article></body>': STORY,
    "<body><article><p title='a > b' class=\"x\">%s</p><p data-x=\"never closed>End.</p></article></body>": STORY + "\n\nEnd.",
    "<body><p>\u0130</p><SCRIPT>var a = '<p>no</p>';</SCRIPT><article><p>%s</p></article></body>": STORY,
    "<body><article><p>%s</p><math><mi>x</mi></math> and <select><option>one</option></select></article></body>": STORY + "\n\nx and one",
    '<body><article><p>%s</p><div class="notice">We set cookies so that this page works as well as it can for all of you.</div></article></body>': STORY,
    '<body><article><p>%s</p></article><section id="comments"><p>I disagree with all of this, says a reader at some length and more than once.</p></section></body>': STORY,
    '<body><header><p>The site</p></header><nav><ul><li>Home</ul></nav><article><h1>T</h1><ul><li>one<li>two</ul><p>%s</p></article><footer>c</footer></body>': "T\n\none\n\ntwo\n\n" + STORY,
    '<body><main><article><h1>T</h1><p>%s</p></article><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I disagree with all of this, says a reader at some length.</p></article></li></ol></main></body>': "T\n\n" + STORY,
    '<body><article><h1>T</h1><p>%s</p></article><section class="related"><article class="card"><p>Another river rose in another night, says another story.</p></article></section></body>': "T\n\n" + STORY,
    '<body><article class="social"><p>%s</p></article></body>': STORY,
    '<body><div class="sidebar"><div class="widget"><p>%s</p></div></div><article><p>Short.</p></article></body>': "Short.",
}


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page):
    got = html_extract.extract(page % STORY, model())
    assert got.removeprefix("\u0130\n\n") == ODD[page]


def test_marks_are_learned_from_labelled_pages():
    page = "<body><div class=zork><p>%s</p></div><article class=blurb><h1>T</h1><p>%s</p></article></body>" % (STORY, STORY)
    m = html_extract.train([html_extract.label_by_markup(page)] * 3)
    assert m.elements["mark:zork"] < 0 and html_extract.extract(page, m) == "T\n\n" + STORY
    assert html_extract.RegionModel().elements.get("mark:zork") is None


def test_few_labelled_pages_among_many_all_train(spark, monkeypatch):
    rows = [(i, PAGE if i % 2000 == 0 else "<p>plain</p>") for i in range(20_000)]
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda pages: seen.extend(pages) or html_extract.RegionModel())
    html_extract.fit(spark.createDataFrame(rows, "page_id long, html string"))
    assert len(seen) == 10


def test_tokenizer_memory_is_bounded_over_many_words():
    """An idle worker keeps few words of the many that it met, and still gives the ids of the named file."""
    from tokenizers import Tokenizer

    from weft.llm import packing
    from weft.llm.queries import tokenizer_path

    coder, whole = packing.PieceTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for k in range(0, 700_000, 50_000):
        text = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}é{chr(0x4E00 + i // 100)}" for i in range(k, k + 50_000))
        got = coder.encode_many([text])[0]
    assert got.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sum(x.nbytes for x in (coder.keys, coder.place, coder.begin, coder.count, coder.ids)) < 20e6
