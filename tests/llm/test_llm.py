"""The training-data operators against brute force, round trips and odd rows."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, html_extract, line_dedup, ngram_join, quality, queries, secrets, token_counts, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, _runs string, h string"
ODD = [(1, None, "en", "x", "y"), (2, "", None, None, None), (3, " \n\t ", "en", "x", "y"), (None, "a b c d e f", "en", "x", "y"), (4, "same words here now again", "en", "x", "y"), (4, "same words here now again", "en", "x", "y"), (5, "word " * 30000, "en", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_html_keeps_the_article_only():
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><header>Top</header><article><h1>Head &amp; line</h1><p>One\n  two<br><p>To.</p><div class='ad'>Buy</div><form><p>Mail</p></form><section id='comments'><p>First!</p></section></article><aside>Side</aside><script>var t='</p>';</script><footer>&copy;</footer>"
    assert html_extract.main_text(page) == "Head & line\nOne two\nTo."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>cut mid &am") == "cut mid &am"


def test_html_surges_without_an_article():
    page = "<body><ul><li><a>Home</a><li><a>About us</a></ul><p>" + "long text " * 20 + "</p><p>short.</p><p>" + "more " * 40 + "</p><ul><li><a>Next</a><li><a>Last</a></ul>"
    assert html_extract.main_text(page).split("\n")[1] == "short." and "Home" not in html_extract.main_text(page) and "Last" not in html_extract.main_text(page)


def test_html_keeps_short_last_blocks_without_an_article():
    links, ad = "<ul><li><a>Home</a><li><a>About us</a></ul>", "<div class='ad'>Buy</div>"
    for end in ("<p>The end.</p>" + links, "<p>The end.</p>" + ad, ad + "<p>The end.</p>" + links):
        page = "<body>" + links + "<p>" + "long text " * 20 + "</p>" + end
        assert html_extract.main_text(page) == ("long text " * 20).strip() + "\nThe end."


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x"), (2, None, "<p>x")], "page_id long, url string, html string")
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in html_extract.extract_main_text(pages).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.score_quality(odd, labels).count() == len(ODD)
    assert quality.score_quality(none, labels.limit(0)).count() == 0


def test_tokens_of_a_trie_equal_a_plain_search(spark, monkeypatch):
    scores = token_counts.pieces(token_counts.default_path())
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            k = len(word[i - 1].encode())
            options = [(best[i - 1][0] + token_counts.BYTE_SCORE * k, best[i - 1][1] - k)]
            options += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
            best.append(max(options))
        return -best[-1][1]

    words = ["the", "then", "thenceforth", "ü", "日本語", "zzzzqqqq", "the", "", "then" * 40]
    words += [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).select("text").collect() for w in (r.text or "").split()]
    monkeypatch.setattr(token_counts, "NODES", 300)
    assert token_counts.count_words(words, scores) == {w: plain("▁" + w) for w in words}


def test_token_counts_of_odd_rows(spark, odd, none):
    """Nulls and blanks have no tokens, repeated rows one result each, words without blanks are counted whole."""
    got = [(r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(odd).collect()]
    assert len(got) == len(ODD) and [x[1:] for x in got if x[0] in (1, 2, 3)] == [(0, 0)] * 3
    assert len({x for x in got if x[0] == 4}) == 1 and next(x for x in got if x[0] == 5)[1] == 30000
    assert token_counts.count_tokens(none).count() == 0
    long = spark.createDataFrame([(1, "ab" * 300_000, 7)], "doc_id long, text string, n_tokens int")
    assert token_counts.count_tokens(long).first().n_pretokens == 1


def test_toxicity_finds_what_the_labels_mark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert np.mean([r.toxic for r in got if r.y == 0]) < 0.02 and np.mean([r.toxic for r in got if r.y == 1]) > 0.75


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in toxicity.score_toxicity(odd, labels).collect()] == [False] * len(ODD)
    assert toxicity.score_toxicity(none, labels).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain_spans(x):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets_equal_plain_expressions():
    rng, pre = random.Random(7), secrets.build_prefilter()
    parts = ["token", "secret", "=", ":", " ", '"', "a", "f0", "0123456789abcdef01234567", "AKIA", "Z9", "é", "İ", "PassWord", "K"]
    for _ in range(500):
        x = "".join(rng.choice(parts) for _ in range(50))
        assert secrets.scan(x, pre)[0] == plain_spans(x)


def test_secret_checksums(spark, odd, none):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = f"ghp_{body}{secrets.crc_tail(body)}", f"ghp_{body}AAAAAA"
    pre = secrets.build_prefilter()
    assert [s[2] for s in secrets.scan(f"x {good} card 4111 1111 1111 1111", pre)[1]] == ["github", "card"]
    assert secrets.scan(f"x {bad} card 4111 1111 1111 1112", pre)[1] == []
    assert {r.base_sha256 for r in secrets.scan_secrets(odd).collect()} == {sha256(b"").hexdigest()}
    assert secrets.scan_secrets(none).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, odd):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for x in [*texts, "\x1cab\x1f", "a".join(map(chr, [*range(1, 0x600), 0x88F, 0x212A, 0x1F600, 0x2F800])), "ΟΔΟΣ it's we'LL İstanbul \x1c x\x1dy <|endoftext|> A<|startoftext|>b ½ 日本語 é", "", "'s"]:
        ids = lib.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_digests(odd).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[5].n_tokens == 30000
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd)).collect()}
    assert sha256(back[4].encode()).hexdigest() == got[4].decoded_sha256


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    r = c.execute(queries.oracle_sql()[name])
    assert [d[0] for d in r.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, r.fetchall()))


def test_line_dedup_cases(spark, odd, none):
    passage = " ".join(f"w{i}" for i in range(60))
    two = " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(30))
    rows = [(1, f"x\n{passage}\nshort line", "en", "", ""), (2, f"other\n{passage}\nshort line\nend", "en", "", ""), (3, two.split("\n")[0], "en", "", ""), (4, two + "\nz", "en", "", ""), (5, "q\n" + two, "en", "", "")]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "other\nend", 3: rows[2][1], 4: rows[3][1], 5: "q"}
    assert line_dedup.delete_repeats(odd).count() == len(ODD) and line_dedup.delete_repeats(odd).columns[:5] == odd.columns
    assert line_dedup.delete_repeats(none).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids, moved = sorted(sets), True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_ngram_components_of_borderline_copies(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, " ".join(base))]
    # a chain that only a row without an id holds together
    chain = [f"v{i}" for i in range(60)]
    rows += [(210, " ".join(chain)), (None, " ".join([*chain[4:], "y1", "y2"])), (211, " ".join([*chain[7:], *"y1 y2 y3 y4 y5".split()]))]
    monkeypatch.setattr(ngram_join, "GROWTH", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    # the row without an id may name no component: it counts as the last of all
    want = brute_components([(10**6 if i is None else i, t) for i, t in rows], 4, 85)
    assert got == {None if i == 10**6 else i: x for i, x in want.items()}


def test_ngram_odd_rows(spark, odd, none):
    got = ngram_join.ngram_components(odd).select("doc_id", "n_shingles", "component_id").collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_components([r for r in rows if r[0] is not None], 5, 80)
    assert len(got) == len(ODD) and all(tuple(r[1:]) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert ngram_join.ngram_components(none).count() == 0


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 4, (300, 6)) / 8
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [1.0]), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    q = np.floor(m * 256).astype(int)
    for i in range(0, 300, 50):
        s = q @ q[i]
        want = sorted((-s[j], j) for j in range(300) if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [(j, -n) for n, j in want]


def test_decontamination_of_changed_slots(spark, odd, none):
    items = spark.createDataFrame([(1, "If Tom has 12 apples and buys 5 kg of pears with Tom paying 12 dollars how much is left for the trip"), (2, None), (3, "one two")], "item_id long, text string")
    rows = [(1, "x y If Bob has 77 apples and buys 9 kg of pears with Bob paying 77 dollars how much is left for the trip end"), (2, "If Bob has 77 apples and buys 9 kg of pears with Sam paying 66 dollars how much is left for the trip"), (3, None), (4, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()] == [(1, 1)]
    assert decontaminate.decontaminate(docs, items).count() == 3
    assert decontaminate.decontaminate(odd, items).count() == len(ODD) and decontaminate.contaminated_pairs(none, items).count() == 0


def test_decontamination_finds_runs_at_every_offset_and_short_items(spark):
    items = spark.createDataFrame([(1, "copper lanterns drift beneath silent harbour walls before every dawn"), (2, "violet engines hum under glass")], "item_id long, text string")
    rows = [(k, "x " * k + "copper lanterns drift beneath silent harbour walls before " + "y " * 9) for k in range(20, 24)]
    rows += [(30, "we heard that violet engines hum under glass and went on"), (31, "we heard that violet engines hum under water and went on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in decontaminate.contaminated_pairs(docs, items).collect())
    assert got == [(k, 1, 8) for k in range(20, 24)] + [(30, 2, 5)]


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Tom has 12 apples in a box. Tom gives away 5 of them. How many are left? Tom counts them all."
    rows = [(1, item.replace("Tom", "Bob")), (2, "Now Bob has 12 apples in a box, so Bob gives away 5 of them. how many are left? Bob counts them all."), (3, "Ann has 12 pears. Ann likes them. Why would anyone ask?")]
    docs = spark.createDataFrame([(i, "Some words come first, and more words. " + x) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.share for r in decontaminate.contaminated_pairs(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 1.0, 2: got[2]} and got[2] > 0.5
    # the values of one name disagree: such words are no equal ones, the others count as before
    mixed = spark.createDataFrame([(1, item.replace("Tom", "Bob", 1).replace("Tom", "Sam"))], "doc_id long, text string")
    assert decontaminate.contaminated_pairs(mixed, spark.createDataFrame([(1, item)], "item_id long, text string")).first().n_words == 21 - 3


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert 0 < docs.count() <= n


def test_html_wrappers_and_pages_without_an_article():
    assert html_extract.main_text("<div class='main-content with-sidebar'><article><p>Body text.</p></article></div>") == "Body text."
    assert html_extract.main_text("<div class='sidebar'><article><p>Body text.</p></article></div>") == "Body text."
    assert html_extract.main_text("<article><p>One.</p><div class='related'><article><p>Other</p></article></div></article>") == "One."
    assert html_extract.main_text("<article><section class='share-price-history'><p>Rose.</p></section><div class='share-buttons'>Tweet</div></article>") == "Rose."
    assert html_extract.main_text("<ul><li><a href='x'>One</a></li><li><a href='y'>Two</a></li></ul>") == ""
    assert html_extract.main_text("<p title='a > b>Lost") == "b>Lost"


def test_html_tables_that_are_empty_or_clash(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, 3, "x"), (1, None, None, 3, "x"), (None, "u", "<p>a&nbsp;b</p>", 4, None)]
    assert sorted((r.n_chars, r.text) for r in html_extract.extract_main_text(spark.createDataFrame(rows, schema)).collect()) == [(0, ""), (0, ""), (3, "a b")]


def test_card_numbers_at_the_edge_of_the_reach():
    """Numbers of 13 to 19 digits with separators are found whole if they begin within the reach, and not at all beyond it."""
    prefilter = secrets.build_prefilter()
    for n in range(13, 20):
        digits = next(d for d in (f"{4 * 10 ** (n - 1) + i}" for i in range(10)) if secrets.luhn(d))
        for number in (digits, " ".join(digits), "-".join(digits)):
            for gap in (1, 35, secrets.CARD_REACH - 4, secrets.CARD_REACH - 3):
                text = "card" + "x" * (gap - 1) + "," + number + "."
                found = secrets.scan(text, prefilter)[1]
                want = [(4 + gap, 5, "card", 4 + gap + len(number))] if 4 + gap <= secrets.CARD_REACH else []
                assert found == want, (n, gap, text)


def test_class_prior_is_at_most_the_share_of_positives():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85):
        positive, other = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
        unlabelled = np.where(rng.random((4000, 1)) < share, rng.normal(1.5, 1, (4000, 3)), other)
        assert share - 0.2 <= quality.class_prior(positive, unlabelled) <= share + 0.01


def test_nn_pu_fit_lowers_an_independently_computed_risk():
    rng = np.random.default_rng(2)
    p = rng.normal(1, 1, (500, 2))
    u = np.r_[rng.normal(1, 1, (250, 2)), rng.normal(-1, 1, (250, 2))]

    def risk(w, b):
        loss = lambda x, sign: np.log1p(np.exp(-sign * (x @ w + b))).mean()
        return 0.5 * loss(p, 1) + max(0.0, loss(u, -1) - 0.5 * loss(p, -1))

    w, b = quality.nn_pu_fit(p, u, 0.5)
    others = [(w + d, b + e) for d in rng.normal(0, 0.3, (40, 2)) for e in (-0.3, 0.3)]
    assert risk(w, b) <= min(risk(np.zeros(2), 0.0), min(risk(*o) for o in others)) + 0.01


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its predecessor's rows: the model's own verdicts, SQL, plain sets, plain search, the library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("_h", F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = (before.toPandas(), docs.toPandas())
    before, after = kept["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(extra, after_schema(spark))), spark.read.parquet(f"{SF}/labels.parquet"))
    weight = {i: sum(model[0].get(f, 0.0) for f in {f for c in set((t or "").split()) for f in toxicity.features_of(c)}) for i, t in zip(before.doc_id, before.text, strict=True)}
    severity = {i: (1 / (1 + np.exp(model[1] - x))).sum() for i, x in weight.items()}
    assert set(after.doc_id) == {i for i, s in severity.items() if s < model[2]}
    before, after = kept["line_dedup"]
    c = duckdb.connect()
    c.register("documents", before)
    want = {r[0]: r[1] for r in c.execute(queries.OP6_SQL).fetchall()}
    assert {i: t or "" for i, t in zip(after.doc_id, after.text, strict=True)} == {i: t or "" for i, t in want.items()}
    before, after = kept["ngram_jaccard_join"]
    groups = brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert set(after.doc_id) == {i for i, (n, least) in groups.items() if not n or i == least}
    before, after = kept["decontamination"]
    assert set(after.doc_id) <= set(before.doc_id) and {10**6, 10**6 + 1} <= set(after.doc_id)
    items = [t.lower().split() for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    plain = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(" ".join(w) in " ".join((t or "").lower().split()) for w in items if len(w) >= 5)}
    assert plain and not plain & set(after.doc_id)
    before, after = kept["bpe"]
    lib = Tokenizer.from_file(bpe.default_path())
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in zip(before.doc_id, before.text, strict=True)}
    assert {i: (n, h) for i, n, h in zip(after.doc_id, after.n_tokens, after.ids_sha256, strict=True)} == {i: (len(x), sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert set(after.doc_id) - {10**6, 10**6 + 1} == set(whole.doc_id)


def after_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_fingerprints_fold_and_bound_the_overlap(spark):
    rng = np.random.default_rng(5)
    for sizes in ((3, 3), (255, 260), (900, 1100), (20_000, 23_000)):
        pool = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
        x, y = pool[: sizes[0]], pool[sizes[0] // 4 :][: sizes[1]]
        flat, words = ngram_join.fingerprints(np.concatenate([x, y]), np.array(sizes))
        maps = [flat[: words[0]], flat[words[0] :]]
        assert all(w & (w - 1) == 0 and ngram_join.LEAST_WORDS <= w <= ngram_join.MOST_WORDS for w in words.tolist())
        k = int(min(words))
        row = spark.createDataFrame([tuple(m.tolist() for m in maps)], "x array<long>, y array<long>")
        got = row.select(*[ngram_join.folded(F.col(c), F.lit(k)) for c in "xy"]).first()
        for fold, m in zip(got, maps, strict=True):
            assert np.array_equal(np.array(fold), np.bitwise_or.reduce(m.reshape(-1, k), axis=0))
        only = sum(bin(a & ~b & (1 << 64) - 1).count("1") for a, b in zip(*got, strict=True))
        assert sizes[0] - only >= len(np.intersect1d(x, y))
