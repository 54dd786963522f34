"""Whole queries against brute force, and the edges of the operators and the pipeline's stages."""

import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracklake.llm import chat, components, exact_dedup, fingerprints, mixing, near_dedup, packing, queries, sharding, shared, toxicity, url_filter

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def spark_hash(*values) -> int:
    """xxhash64 of Spark: each value's hash seeds the next one's; unsigned."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


# --- op2


def test_op2_packs_every_piece(spark, table):
    lib = pytest.importorskip("tokenizers")
    import public_tokenizers

    plain = lib.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, t, *_ in table:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for k, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            want.append((i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
    got = queries.op2_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    end = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r["offset"])):
        assert end[r.sequence_id] == r["offset"]
        end[r.sequence_id] += r.length
    assert max(end.values()) <= 2048 and len(end) <= -(-sum(n for *_, n, _ in want) // 2048) + 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = packing.sequences(docs).collect()
    assert sorted(len(r.ids) for r in made) == sorted(end.values()) and sum(len(r.starts) for r in made) == len(want)


# --- op4


def hilbert(n: int, bits: int) -> dict[tuple, int]:
    """Cells by their place on Skilling's curve: from an index's transposed bits, the Gray code and the
    exchanges are undone from the lowest bit up."""
    out = {}
    for h in range(1 << n * bits):
        x = [0] * n
        for k in range(n * bits):
            x[k % n] |= (h >> (n * bits - 1 - k) & 1) << (bits - 1 - k // n)
        t = x[-1] >> 1
        for i in range(n - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= t
        q = 2
        while q < 1 << bits:
            for i in range(n - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    flip = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= flip
                    x[i] ^= flip
            q <<= 1
        out[tuple(x)] = h
    return out


def test_op4_follows_the_curve(spark, table):
    place = hilbert(3, sharding.BITS)
    sizes = sorted(n for *_, n in table if n is not None)
    steps = 1 << sharding.BITS
    cuts = [sizes[max(0, -(-k * len(sizes) // steps) - 1)] for k in range(1, steps)]

    def order(row):
        i, _, lang, source, n = row
        cell = tuple(0 if v is None else signed(spark_hash(v)) % steps for v in (lang, source)) + (sum(n is not None and n >= c for c in cuts),)
        return place[cell], signed(spark_hash(i)) % sharding.SALTS, i

    ranked = sorted(table, key=order)
    q, r = divmod(len(ranked), 8)
    spots = [(s, k) for s in range(8) for k in range(q + (s < r))]
    want = {row[0]: (len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode()), "rows", *spot, None) for row, spot in zip(ranked, spots, strict=True)}
    got = queries.op4_hilbert_sharding(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in got} == want and len(got) == len(table)


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), file_rows=10, shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and len(list((tmp_path / "s").glob("shard=*"))) == 3
    for f in (tmp_path / "s").glob("shard=*/*.parquet"):
        slots = [r[0] for r in duckdb.sql(f"SELECT slot FROM '{f}'").fetchall()]
        assert slots == sorted(slots)


# --- op6


def fingerprint(text: str) -> str:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return ""
    hashes = [spark_hash(*words[k : k + 5]) for k in range(max(1, len(words) - 4))]
    bins = {}
    for h in hashes:
        h &= (1 << 63) - 1
        b = h >> 55
        bins[b] = min(h, bins.get(b, h))
    out = ""
    for b in range(256):
        t = 0
        at = b
        while at not in bins:
            at = (fingerprints.STEP[b] * t + fingerprints.START[b]) % 256
            t += 1
        out += "0123456789abcdef"[bins[at] & 15]
    return out


def alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 1 / 16) / (15 / 16)))


def test_op6_equals_a_plain_reading(spark, table):
    rows = sorted(((i, t or "") for i, t, *_ in table), reverse=True)
    prints = {i: fingerprint(t) for i, t in rows}
    want = {}
    for (i, t), (j, u) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        e = fingerprint(edited)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], e, round(alike(prints[i], e), 9), round(alike(prints[i], prints[j]), 9))
    got = queries.op6_fingerprints(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want


def test_op6_next_over_nulls_and_ties(spark):
    dice = random.Random(3)
    rows = [((k << 54) + dice.randrange(9) if k % 3 else None, f"text {dice.randrange(10**6)} " * 9) for k in range(300)] + [(7, "tie b"), (7, "tie a"), (None, "tie"), (None, "tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for ranges in (1, 3, 64):
        got = fingerprints.with_next(df, ["text"], ranges).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(spark_hash(r[1])) if r[0] is None else 0, r[1]))
        after = [t for _, t in [*order[1:], order[0]]]
        assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter((i, t, n) for (i, t), n in zip(order, after, strict=True))


# --- op8


def test_op8_scores_as_the_model_says(spark, table):
    marks = defaultdict(int)
    for i, t in duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall():
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(marks[i], t)
    train = [(t, marks[i]) for i, t, *_ in table if i in marks]
    model = toxicity.fit([t for t, _ in train], [m for _, m in train], sum(marks.values()) / len(marks))

    def grams(text):
        out = set()
        points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
        for n in toxicity.ORDERS:
            for k in range(len(points) - n + 1):
                h = 0
                for m, p in enumerate(points[k : k + n], 1):
                    h = (h * 0x9E3779B97F4A7C15 + p + m) & MASK
                out.add(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 64 - toxicity.HASH_BITS)
        return out

    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    assert len(got) == len(table)
    for i, t, *_ in table:
        z = model.bias + sum(float(model.weights[f]) for f in grams(t or ""))
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-6 and got[i].predicted == (got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_takes_the_least_of_several_texts(spark):
    rows = [(k, ("bad word " if k % 2 else "good one ") + str(k)) for k in range(200)]
    more = [(k, "zzz other") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    one = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    two = toxicity.train(spark.createDataFrame(more + rows, "doc_id long, text string"), labels)
    assert one.bias == two.bias and (one.weights == two.weights).all()


# --- op9


def leaf_of(lang, source, recipe):
    return f"domain{md5_hash(source) % recipe.domains if source is not None else 0}", lang, source


def md5_hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_op9_selects_what_the_budgets_say(spark, table):
    recipe = mixing.RECIPE
    n_tokens = lambda t: len((t or "").replace("\x0b", " ").replace("\x0c", " ").encode().split())
    have = Counter()
    for _, t, lang, source, _ in table:
        have[leaf_of(lang, source, recipe)] += n_tokens(t)
    want = Counter()
    for leaf, target in mixing.leaf_budgets(dict(have), recipe).items():
        mine = [(i, n_tokens(t)) for i, t, lang, source, _ in table if leaf_of(lang, source, recipe) == leaf]
        whole, rest = (target // have[leaf], target % have[leaf]) if have[leaf] else (1, 0)
        want.update((i, e) for i, _ in mine for e in range(whole))
        order = sorted((md5_hash(f"{recipe.seed}:{whole}:{i}"), i, n) for i, n in mine)
        for k, (_, i, _) in enumerate(order):
            if rest and sum(n for *_, n in order[: k + 1]) <= rest:
                want[i, whole] += 1
    got = queries.op9_mixing(spark, SF).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == want and max(e for _, e in want) > 0
    tokens = {i: n_tokens(t) for i, t, *_ in table}
    assert all(r.tokens == tokens[r.doc_id] and (r.domain, r.lang, r.source) == leaf_of(r.lang, r.source, recipe) for r in got)


def test_prefixes_end_anywhere(spark):
    """The last hashes of all, and hashes that only their low bits tell apart."""
    top, low = (1 << mixing.HASH_BITS) - 1, 5 << 40
    hashes = [(h, 3) for h in (0, 1, 2, low, low + 1, low + (1 << 30), top - 1, top)]
    for rest in range(len(hashes) * 3):
        rows = spark.createDataFrame([("a", rest, 0, n, h) for h, n in hashes], "leaf string, rest long, before long, tokens long, h long").coalesce(1)
        at = mixing._end(rows, mixing.HASH_BITS - mixing.BITS).first()
        mine = [(h, n) for h, n in hashes if at["from"] <= h <= at["to"]]
        before = sum(n for h, n in hashes if h < at["from"])
        assert at.before == before <= rest < before + sum(n for _, n in mine)


def test_budgets_as_a_table_and_in_memory(spark):
    dice = random.Random(11)
    for turn in range(6):
        names = {"domain": "abc", "lang": ["en", "de", None], "source": "xyzuvw"}
        leaves = {(d, lang, s): dice.choice([0, 1, 10, 1000, 12345]) for d, lang, s in itertools.product(*names.values()) if dice.random() < 0.7}
        weights = {level: {n: dice.choice([0, 0.1, 1, 2.5]) for n in names[level]} for level in mixing.LEVELS} if turn else {}
        recipe = mixing.Recipe(weights, budget=dice.choice([0.1, 0.5, 2.0]), max_epochs=dice.choice([1, 3]))
        schema = "leaf struct<domain: string, lang: string, source: string>, n long"
        got = {tuple(r.leaf): r.target for r in mixing.budgets(spark.createDataFrame(list(leaves.items()), schema), recipe).collect()}
        want = mixing.leaf_budgets(leaves, recipe)
        assert set(got) == set(want) and sum(got.values()) == sum(want.values())
        # Leftover tokens of rounding may go to another sibling on each of three levels.
        assert all(abs(got[k] - want[k]) <= 3 * len(leaves) ** 0.5 for k in want)


def test_no_token_is_lost_below_a_weight_of_zero(spark):
    leaves = {("a", "en", "x"): 1000, ("a", "en", "y"): 10, ("b", "en", "z"): 1000}
    recipe = mixing.Recipe({"source": {"x": 0.0}}, max_epochs=1)
    assert mixing.leaf_budgets(leaves, recipe, 800) == {("a", "en", "x"): 0, ("a", "en", "y"): 10, ("b", "en", "z"): 790}
    schema = "leaf struct<domain: string, lang: string, source: string>, n long"
    rows = mixing.budgets(spark.createDataFrame(list(leaves.items()), schema), mixing.Recipe(recipe.weights, budget=800 / 2010, max_epochs=1)).collect()
    assert {r.leaf.source: r.target for r in rows} == {"x": 0, "y": 10, "z": 790}


def test_many_leaves_take_the_shuffle(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = sorted((r.doc_id, r._epoch) for r in mixing.select_rows(df).collect())
    monkeypatch.setattr(mixing, "LEAF_BROADCAST", 0)
    assert few == sorted((r.doc_id, r._epoch) for r in mixing.select_rows(df).collect())


# --- names, ids and sizes at the edge


CLASHING = ["_id", "_digest", "_many", "_d", "_n", "_u", "_keep", "_total", "_at", "_part", "_cell", "_rank", "_number", "_shard", "_slot", "_cut", "_of_lang", "_domain", "_epoch", "_epochs", "_leaf", "_gone", "_text_key", "leaf", "row", "rows", "n", "h", "digest", "node", "component", "locator"]


@pytest.fixture(scope="module")
def clashing(spark):
    base = [(1, "one two", "en", "s"), (2, "one two", "en", "s"), (2, "onetwo", None, None), (2, "onetwo", None, None), (None, None, "de", "t"), (3, "x " * 60, "de", "t"), (None, "x " * 60 + "y", "de", "t")]
    rows = [(*r, len(r[1] or ""), *(f"{c}{k}" for c in CLASHING)) for k, r in enumerate(base)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def test_extra_columns_keep_their_values(spark, clashing):
    before = {tuple(r) for r in clashing.select(*CLASHING).collect()}
    assert {tuple(r) for r in sharding.shard_rows(clashing).select(*CLASHING).collect()} == before
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns and {tuple(r) for r in kept.select(*CLASHING).collect()} <= before and kept.count() == 4
    rows = mixing.select_rows(clashing)
    assert rows.columns[: len(clashing.columns)] == clashing.columns and len(rows.columns) == len(clashing.columns) + 2
    assert {tuple(r) for r in rows.select(*CLASHING).collect()} <= before
    near = near_dedup.drop_near_copies(clashing)
    assert near.columns == clashing.columns and {tuple(r) for r in near.select(*CLASHING).collect()} <= before
    assert url_filter.filter_urls(clashing.withColumn("url", F.lit("a://b/c")), queries.RULES).count() == 7


def test_exact_dedup_of_extreme_ids(spark):
    rows = [(-(1 << 63), "a b"), ((1 << 63) - 1, "ab"), (0, "a b"), (None, "a b"), (None, None), (5, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low, high = -(1 << 63), (1 << 63) - 1
    assert got == {(low, low, 4, True), (high, low, 4, False), (0, low, 4, False), (None, low, 4, False), (None, 5, 2, False), (5, 5, 2, True)}


def test_near_copies_without_ids(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*base, f"end{k}"]) for k in range(3)]
    rows = [(None, t, k) for k, t in enumerate(texts)] + [(None, "quite another text without id " * 3, 7)]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert len(left) == 2 and sum(r.k < 3 for r in left) == 1
    rows = [(9, texts[0]), (None, texts[1]), (None, texts[2])]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {9}


def test_linked_sizes_share_a_sketch(spark):
    """Sizes around SHORT, pair by pair: both carry the sketch of short texts or both that of long ones."""
    for percent in (80, 85, 100):
        short = lambda n: n <= near_dedup.SHORT / (percent / 100)  # noqa: B023, E731
        long = lambda n: n >= near_dedup.SHORT * (percent / 100)  # noqa: B023, E731
        for a, b in itertools.product(range(1, 200), repeat=2):
            if 100 * min(a, b) >= percent * max(a, b):
                assert short(a) and short(b) or long(a) and long(b)
    rows, want = [], set()
    for k, n in enumerate(range(50, 84)):
        words = [f"{n}w{j}" for j in range(n + 4)]
        part = words[: -(-85 * n // 100) + 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(part))]
        want.add(2 * k + 1)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if not r.kept} == want and len(got) == len(rows)


def test_large_clusters_and_hubs(spark, monkeypatch):
    """One family of near copies around a hub, and a chain that leads out of it."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[: 150 + k % 3], f"v{k}", *base[151 + k % 3 :]])) for k in range(1, 120)]
    chain = list(base)
    for k in range(200, 215):
        at = 12 * (k - 200)
        chain[at : at + 6] = [f"c{k}_{j}" for j in range(6)]
        rows.append((k, " ".join(chain)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == group


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 500)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (5000, 4999), (4999, 5000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(500)} | {k: 1000 for k in range(1000, 1101)} | {5000: 4999, 4999: 4999}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_meet_joins_as_a_join_does(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(400)] + [(None, 1), (99999, 2)], "key long, x long")
    sums = rows.where("key < 50000").groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("m"))
    want = sorted(map(tuple, rows.join(sums.drop("n"), "key").select("key", "x", "m").collect()))
    assert sorted(map(tuple, shared.meet(rows, sums, "key", 402).select("key", "x", "m").collect())) == want


def test_shared_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_long_conversations(spark):
    turns = [(1, k, "assistant" if k % 3 == 0 else "user", f"turn {k} <sep/>") for k in range(3000)] + [(2, 0, "assistant", "long " * 200_000)]
    done = chat.read_back(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    for r in done.collect():
        mine = [t for t in turns if t[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in mine]
        assert r.loss_text == "".join(t[3] for t in mine if t[2] == "assistant")


def test_urls_run_by_bytes(spark, monkeypatch):
    urls = [f"http://{'x.' * (k % 90)}net/{'p' * (k % 700)}" for k in range(500)] + ["http://a.net/" + "q" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    whole = sorted(map(tuple, url_filter.filter_urls(df, queries.RULES).collect()))
    monkeypatch.setattr(url_filter, "STEP_BYTES", 500)
    assert whole == sorted(map(tuple, url_filter.filter_urls(df, queries.RULES).collect()))


# --- the pipeline's stages


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, shard int, _epoch int"
    texts = [None, "", "one", "one", "o n e", "alpha beta gamma " * 30_000, "alpha beta gamma " * 30_000 + "end", " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(81))]
    rows = [(k if k % 4 else None, t, "en" if k % 2 else None, "s" if k % 3 else None, None if t is None else len(t), f"x{k}", k, k) for k, t in enumerate(texts)]
    rows += [(2, "one", "en", "s", 3, "twice", 1, 1), (2, "one", "en", "s", 3, "twice", 1, 1)]
    folder = tmp_path / "sf"
    spark.createDataFrame([(2, 0, 1)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(folder / "labels.parquet"))
    for name, some in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for stage, f in corpus_pipeline.STAGES:
            out = shared.materialise(f(spark, docs, str(folder)), f"{name}-{stage}")
            if stage != "packing":
                assert out.columns == docs.columns
                docs = out
            if some and stage == "toxicity":
                assert out.count() == len(rows)
            if some and stage == "exact_dedup":
                assert out.count() == len({"".join((r[1] or "").split()) for r in rows})
            if some and stage == "near_dedup":
                assert sorted(len(r.text.split()) if r.text else 0 for r in out.collect()) == [0, 3, 80, 90_000, 90_001]
        assert (out.count() > 0) == bool(some)


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "pages", "conversations", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda x: sorted(str([str(v) for v in r]) for r in x[columns].itertuples(index=False, name=None))  # noqa: B023, E731
        assert rows(got) == rows(want), name
