"""Edge cases and brute force on small fixtures."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.llm import chat, exact_dedup, fingerprints, html_extract, mixing, near_dedup, packing, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, digest int, shard string, length int, leaf int"
EXTRA = ("x", 1, "y", 2, 3)
LONG = "alpha beta gamma delta " * 20000


def rows():
    texts = [(1, ""), (2, None), (3, "one"), (3, "one"), (4, "one"), (5, LONG), (6, LONG + "end"), (None, "some text of a row without an id"), (7, "w " * 9), (8, "O n e")]
    return [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None, len(t) if t else None, *EXTRA) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows()) and exact_dedup.exact_dedup(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.digest, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {1} and {r.keep_id for r in got if r.doc_id in (3, 4)} == {3}
    assert exact_dedup.drop_copies(docs).count() == len(by) and exact_dedup.drop_copies(docs).columns == docs.columns


def test_exact_dedup_checks_bytes(spark, docs):
    """With a digest that collides, full bytes tell the texts apart."""
    right = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    weak = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, digest=lambda t: F.lit("same"), max_files=1).collect()}
    assert right == weak


def shingles(text):
    w = near_dedup.Shingler().words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts, percent=85):
    ids, sets = list(texts), {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in ids}
    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    return group, sets


def test_near_dedup(spark, docs, none, monkeypatch):
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows()) and near_dedup.near_dedup(none).count() == 0
    assert {r.doc_id: r.n_shingles for r in got}[1] == 0
    dice = random.Random(5)
    texts, at = {}, 0
    for n in (7, 30, 70, 90, 400):
        base = [f"w{dice.randrange(9999)}" for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for _ in range(dice.randrange(3)):
                w[dice.randrange(n)] = f"v{dice.randrange(9999)}"
            texts[at] = " ".join(w)
            at += 1
    want, sets = brute(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_dedup(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(got[i].n_shingles == len(s) for i, s in sets.items())
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # clusters cut into many tasks
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == want


def test_near_copies_go_by_text_not_by_id_alone(spark):
    first, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "wz")
    df = spark.createDataFrame([(1, first), (5, first + " end"), (5, other), (None, other + " end"), (6, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()} >= {(1, first), (5, other), (6, None)}
    assert (5, first + " end") not in {(r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()}


def test_near_dedup_takes_a_threshold(spark, monkeypatch):
    """At 80, pairs from 0.80 to 0.85 are linked, below and above SHORT, whole and cut into tasks."""
    dice, texts, want = random.Random(9), [], {80: set(), 85: set()}
    for k, (n, share) in enumerate(itertools.product((25, 50, 62, 70, 78, 200, 400), (0.77, 0.80, 0.82, 0.84, 0.87))):
        base = [f"w{dice.randrange(10**6)}" for _ in range(n + 4)]  # n shingles, of which a prefix has a share
        part = base[: int(np.ceil(n * share)) + 4]
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(part))]
        a, b = shingles(texts[-2][1]), shingles(texts[-1][1])
        for percent, linked in want.items():
            if 100 * len(a & b) >= percent * len(a | b):
                linked.add(2 * k + 1)
    assert len(want[80] - want[85]) >= 14
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (near_dedup.BLOCK, 1):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        for percent, linked in want.items():
            got = near_dedup.near_dedup(df, percent).collect()
            assert {r.doc_id for r in got if not r.kept} == linked
            assert all(r.component_id == r.doc_id - (r.doc_id in linked) for r in got)
    left = {r.doc_id for r in near_dedup.drop_near_copies(df, 80).collect()}
    assert left == {i for i, _ in texts} - want[80]


def test_estimate_gate_misses_less_than_the_bands():
    gate = math.erfc(near_dedup.SIGMAS / math.sqrt(2)) / 2
    assert gate < (1 - (near_dedup.PERCENT / 100) ** near_dedup.ROWS) ** near_dedup.BANDS


def test_estimate_is_close():
    dice = np.random.default_rng(1)
    for n, share in ((50, 0.9), (2000, 0.85), (2000, 0.5)):
        a = dice.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], dice.integers(0, 2**63, n - int(n * share)).astype(np.uint64)])
        true = int(n * share) / (2 * n - int(n * share))
        s = near_dedup.SEEDS["b"]
        load = np.array([n * s / near_dedup.REGISTERS])
        got = near_dedup.estimate(near_dedup.sketch(a, s)[None], near_dedup.sketch(b, s)[None], load, load)[0, 0]
        assert abs(got - true) < 0.12


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(rows()) and fingerprints.fingerprint_edits(none).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1 and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    one = fingerprints.fingerprint_edits(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_sharding(spark, docs, none):
    got = sharding.shard_rows(docs, shards=3).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(3)]
    assert sum(sizes) == len(rows()) and max(sizes) - min(sizes) <= 1 and sharding.shard_rows(none).count() == 0
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert sharding.shard_rows(docs.where("doc_id IN (5, 6)"), shards=8).count() == 2


def test_hilbert_steps_are_neighbours(spark):
    for n, b in ((2, 3), (3, 2)):
        cells = spark.range(1 << n * b).select(sharding.steps_of("id", n, b).alias("c"))
        order = sorted((r.h, r.c) for r in sharding.with_hilbert(cells, "c", "h", n, b).collect())
        assert [h for h, _ in order] == list(range(1 << n * b))
        assert all(sum(abs(p - q) for p, q in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in itertools.pairwise(order))


def test_packing(spark, docs, none):
    got = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    lib = pytest.importorskip("tokenizers")
    import public_tokenizers

    plain = lib.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, t, *_ in rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [packing.END]
        want += [(i or 0, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_bins([(r.sequence_id, r["offset"], r.length) for r in got])


def check_bins(placed, capacity=packing.CAPACITY):
    end = {}
    for s, at, n in sorted(placed):
        assert at == end.get(s, 0)
        end[s] = at + n
    assert max(end.values()) <= capacity
    return len(end)


def test_special_strings_are_tokens():
    lib = pytest.importorskip("tokenizers")
    import public_tokenizers

    text = "a<|endoftext|> b  \n\n c' 's 12é漢"
    assert packing.load_tokenizer().encode(text, allowed_special="all") == lib.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode(text, add_special_tokens=False).ids


def test_plan_is_tight():
    dice = random.Random(2)
    for _ in range(20):
        sizes = [min(2048, 1 + int(dice.expovariate(1 / 600))) for _ in range(1500)]
        count = {s: sizes.count(s) for s in set(sizes)}
        slots, bins = packing.plan_bins(count)
        placed = [(first + k, at, n) for n, _, c, first, at in slots for k in range(c)]
        assert len(placed) == 1500 and check_bins(placed) == bins <= 1.02 * sum(sizes) / 2048 + 1
        assert all(sum(3 * n > 2048 for b, _, n in placed if b == x) <= 2 for x in range(0, bins, 50))


def test_url_filter(spark):
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "x.org", "/" + "long" * 40)]
    urls = ["http://a.EXAMPLE.net/en/x", "http://example.net/de", "http://notexample.net/en/", "http://net", "http://net/", None, "no scheme", "a://b://x.net/", "http://x.org/" + "long" * 5000, "http://foo.com/x.net/"]
    df = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path[:4], r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got[0] == ("a.example.net", "/en/", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == (None, "allow") and got[4][2:] == ("net/", "block") and got[5] == ("", "", None, "allow") == got[6]
    assert got[7] == ("b:", "//x.", None, "allow") and got[8][3] == "block" and got[9][3] == "allow"
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0 and url_filter.filter_urls(df, []).where("verdict = 'allow'").count() == len(urls)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "</turn>", "\\</turn>", "<turn>a</role>b<sep/>", "<\\turn>", "<", "turn>", "x\n\\\\<sep/>"]
    turns = [(c, t, r, x, "extra") for c, (t, r, x) in itertools.product((1, 2), zip(range(10), ["user", "assistant", "assistant", None, "a</role>"] * 2, odd, strict=True))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.read_back(chat.format_conversations(df))
    for r in done.collect():
        mine = [(a or "", x or "") for c, _, a, x, _ in turns if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss_text == "".join(x for a, x in mine if a == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>home<li>about</ul></nav><!-- c --><div class=ad>buy</div><article><h1>T &amp; U</h1><p><b>one <i>two</i><br><p>three&nbsp;\n four<script>x('</p>')</script><div class='comments'><p>nice</div></article><footer>f</footer>"
    soup = "<body><div id=top>same bar</div><div id=text><p>{}</p><p>{} more</p></div></body>"
    pages = [(1, "http://a/1", page), (2, None, None), (3, "x", ""), (4, "http://a/2", "<p>cut <b>sho"), *((10 + k, "http://s/x", soup.format(f"text {k}", k)) for k in range(8))]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "T & U\none two\nthree four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "cut sho"
    assert got[12].text == "text 2\n2 more"  # the bar that all pages of the site share is gone
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_tree_decides_inside_articles(spark):
    page = "<body><article><h1>T{0}</h1><div id=text><p>text {0}</p></div><div id=box>same box</div></article><div class=comments><article><p>me too {0}</p></article></div>"
    copy = "<body><article><div id=text><p>a copy</p></div></article>"
    pages = [*((k, "http://a/x", page.format(k)) for k in range(8)), *((k, "http://b/x", copy) for k in range(10, 14))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"T{k}\ntext {k}" for k in range(8)}, **{k: "a copy" for k in range(10, 14)}}
    read = lambda page: html_extract.main_text(html_extract.parse(page), {})
    assert read("<body><div class=related-layout><article><p>one</article></div>") == ["one"]  # nothing else is declared
    assert read("<body><aside><main><p>one</main></aside><article><p>two</article>") == ["one", "two"]


def test_html_page_ids_do_not_split_branches(spark):
    soup = "<body class='postid-{0}'><div id='post-{0}'><div id=top>same bar</div><div id=text-{1}><p>text {0}</p></div></div></body>"
    pages = [(k, "http://s/x", soup.format(k, f"{k * 7919:x}")) for k in range(100, 108)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {k: f"text {k}" for k in range(100, 108)}
    assert {r.pages for r in html_extract.style_tree(df).collect()} == {8}


def test_html_article_in_inline_parents():
    read = lambda page: html_extract.main_text(html_extract.parse(page), {})
    inner = "<article><h1>T</h1><p>one <b>two</b></p></article>"
    for page in ("<body><app-root>x<main>{}</main>y</app-root>", "<body>x<span id=top>{}</span>", "<body><b>bold{}", "<body><a href=x>{}", "<font><b>loose{}</b></font>tail"):
        assert read(page.format(inner)) == ["T", "one two"], page
    assert read("<body><h1>T</h1>loose<article><p>one</article>") == ["T", "one"]
    assert read("<body><h1>Site</h1>" + inner) == ["T", "one two"]
    assert read("<body>" + "<b>" * 30000 + inner) == ["T", "one two"]


def test_toxicity(spark, docs, none):
    dice = random.Random(4)
    texts, marks = [], []
    for k in range(600):
        w = ["".join(dice.choices("abcdeo", k=5)) for _ in range(40)]
        if k % 4 == 0:
            w[dice.randrange(40)] = dice.choice(["Idiotic", "horrid"])
        texts.append(" ".join(w))
        marks.append(int(k % 4 == 0))
    df = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*enumerate(marks), (None, 1), (9999, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95
    model = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, model).where("score < 0.5").count() == len(rows()) and toxicity.score(none, model).count() == 0
    assert toxicity.drop_toxic(docs, model).count() == len(rows())


def test_water_fill_and_tree():
    assert mixing.water_fill(100, [(1, 10), (1, 1000)]) == [10, 90]
    assert mixing.water_fill(10**6, [(1, 10), (3, 20)]) == [10, 20]
    leaves = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("b", "en", "z"): 1000}
    got = mixing.leaf_budgets(leaves, mixing.Recipe(max_epochs=1), 600)
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 290, ("b", "en", "z"): 300}  # x's shortage stays in a


def test_mixing(spark, docs, none):
    assert mixing.select_rows(none).count() == 0 and mixing.select_rows(docs).count() >= 0
    dice = random.Random(6)
    data = [(k, "w " * dice.randrange(1, 60), "en" if k % 3 else "de", f"s{k % 5}") for k in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    recipe = mixing.Recipe({"lang": {"en": 0.2, "de": 0.8}}, budget=0.9, max_epochs=3)
    plan = {(r._domain, r.lang, r.source): r for r in mixing.plan(df, recipe).collect()}
    got = mixing.select_rows(df, recipe).withColumn("n", mixing.tokens(F.col("text"))).collect()
    keys = {r.doc_id: r.h for r in df.select("doc_id", F.lit(0).alias("e")).select("doc_id", mixing.order_hash(F.col("doc_id"), F.col("e"), recipe).alias("h")).collect()}
    for leaf, p in plan.items():
        mine = [r for r in got if (r._domain, r.lang, r.source) == leaf]
        assert sum(r.n for r in mine) <= p.target and p.target - sum(r.n for r in mine) < 60
        if p.epochs == 0:  # a prefix of the leaf in hash order, as long as the budget allows
            order = sorted((keys[i], len(t.split())) for i, t, lang, s in data if (lang, s) == leaf[1:])
            total = list(itertools.accumulate(n for _, n in order))
            assert len(mine) == sum(x <= p.target for x in total)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.shared.table(spark, sf, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.shared.materialise(stage(spark, docs, sf), name)
        if name == "exact_dedup":
            assert out.count() == len({"".join((r.text or "").split()) for r in docs.select("text").collect()})
        if name == "near_dedup":
            groups, _ = brute({r.doc_id: r.text for r in docs.collect()}, corpus_pipeline.NEAR_PERCENT)
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(groups.values())
        if name != "packing":
            assert out.columns == docs.columns
            counts.append(out.count())
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    check_bins([(r.sequence_id, r["offset"], r.length) for r in out.collect()])
