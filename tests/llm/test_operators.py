"""Each operator against a brute-force version on small rows with every awkward case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("maskweave.llm")
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from maskweave.llm import decontam, dedup, encode, htmltext, jaccard, packing, pii, quality, secretscan, tokenio, toxicity, util  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, spans string, kept string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "The", "of", "été", "zeta", "eta", "theta", "iota", "kappa."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = words(rng, 3000)
    near = words(rng, 120)
    near2 = near.split()
    near2[60] = "changed"
    secret = 'see token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and Zk3vQ9xT7pLw2Rb8Yc5Nd1Hf6Gj4Ms0 with get_user_name_from_config_file there'
    private = "zorblat quixel mail a.b+c@mail.example.com from 10.0.0.1 card 4111 1111 1111 1111 or +1 (201) 555-0123 now"
    texts = [None, "", " \t\n", "one", "one two three", near, near, " ".join(near2), long, secret, private, private + " " + words(rng, 10), "A\nB c\nA\nB c\n\nA", "x " * 80, words(rng, 60) + "\n" + near, "日本 " * 30, near.upper()]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[5], (None, near, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_library():
    rng = random.Random(0)
    enc = encode.Encoder(cache=300)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for alphabet in ("abé é́'st<|endoftext|> \n\t\x0b\x1c\u0085Σς İ!?12３×÷Àß", "aé 's't're've'll'm'd , ß9\n") for _ in range(400)]
    texts += ["<|endoftext|> a<|startoftext|>", "don't", "'", "it's", "x're", "", "''s", "a" * 5000]
    values, off = enc.encode(pa.array([*texts, None]), 7)
    for i, t in enumerate([*texts, ""]):
        assert enc.tokenizer.encode(t, add_special_tokens=False).ids + [7] == values[off[i] : off[i + 1]].tolist(), t


def test_quality(docs, none, rows):
    got = collections.Counter(tuple(r) for r in quality.judge(docs).drop("kept", "host_verdict").collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert got == want
    assert quality.judge(none).count() == 0 and quality.keep(none).columns == docs.columns
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


def test_hosts_are_shrunk(spark):
    hosts = spark.createDataFrame([("bad", 400, 396), ("small", 1, 1), *[(f"h{i}", 300, 20 + i) for i in range(20)]], "_host string, n long, k long")
    v = {r._host: (r.rate, r.verdict) for r in quality.host_verdicts(hosts, 0.5, 0.95).collect()}
    assert v["bad"][1] == 2 and v["small"][0] < 0.9 and v["h3"][1] == 0


def test_jaccard(docs, none, rows):
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == collections.Counter(brute.components(rows))
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in brute.components(rows) if c is not None})


def test_jaccard_random_sets(spark):
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 60)).split() for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["p", "q", "r"])
        rows.append((i, " ".join(w + [rng.choice("uvw")] * rng.randint(0, 6))))
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect())
    assert got == sorted(brute.components(rows))


def bridge_rows():
    """0 - null - 2: only the document without an id links the two others."""
    w = [f"w{i}" for i in range(60)]
    return [(0, " ".join(w)), (None, " ".join(w[3:] + ["x1", "x2", "x3", "x4"])), (2, " ".join(w[6:] + ["x1", "x2", "x3", "x4", "y1", "y2", "y3"])), (7, "quite another text of some words")]


@pytest.mark.parametrize("limits", [(1 << 16, 128, 500_000, 2_000_000), (100, 3, 0, 300), (1, 1, 0, 1)])
def test_jaccard_blocks_and_bridges(spark, monkeypatch, limits):
    """Components in many blocks, with pivots that link all, some or none, and classes that no id names."""
    for name, v in zip(("BLOCK", "BLOCK_SETS", "BROADCAST_ROWS", "WIDE"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, v)
    rng = random.Random(11)
    rows = bridge_rows()
    base = words(rng, 50).split()
    for i in range(40):  # a chain of texts that link with their neighbours alone, and copies of one text
        w = list(base)
        w[rng.randrange(50)] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, " ".join(f"c{j}" for j in range(5 * i, 5 * i + 60))), (None if i % 7 else 300 + i, " ".join(f"d{j}" for j in range(4 * i, 4 * i + 60)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == collections.Counter(brute.components(rows))


def test_components_both_ways(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(50)] + [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    here = sorted(tuple(r) for r in util.components(df, "a", "b").collect())
    monkeypatch.setattr(util, "LOCAL_EDGES", 0)
    assert sorted(tuple(r) for r in util.components(df, "a", "b").collect()) == here


def test_blocks_of_a_large_component(spark, monkeypatch):
    rng = random.Random(2)
    base = words(rng, 60).split()
    rows = [(i, " ".join(base[: 55 + i % 5] + [f"t{i}"])) for i in range(40)]
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.components(rows))


def ids_of(text, end):
    tok = encode.encoder().tokenizer
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(docs, none, rows):
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(r[1], 1)) for r in rows)
    by_sequence = collections.defaultdict(list)
    left = collections.Counter()
    for r in rows:
        left[r[0]] += len(ids_of(r[1], 1))
    for p in pieces:
        left[p.doc_id] -= p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        t = next(r[1] for r in rows if r[0] == p.doc_id)
        ids = ids_of(t, 1)
        assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert not any(left.values())
    for s in by_sequence.values():
        s.sort()
        assert sum(n for _, n in s) <= 2048 and [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
    assert packing.pack(none).count() == 0
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    seq = packing.materialise(unique, packing.pack(unique)).collect()
    assert all(len(s.ids) == 2048 or len(s.ids) == s.n_ids for s in seq)


def test_repeated_rows_that_are_cut(spark, monkeypatch):
    monkeypatch.setattr(packing.Slots, "__init__", lambda self, lengths, *_: (setattr(self, "sequences", 0), setattr(self, "by_class", {}), setattr(self, "taken", np.zeros(int(lengths.max(initial=0)) + 1, np.int64)), None)[-1])
    t = words(random.Random(3), 700)
    d = spark.createDataFrame([(5, t)] * 7, "doc_id bigint, text string").repartition(2)
    ids = ids_of(t, 1)
    pieces = packing.pack(d).collect()
    assert sum(p.length for p in pieces) == 7 * len(ids) and len({p.start for p in pieces}) == 3
    assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = rng.integers(1, 400, 512).astype(float)
    lengths = np.arange(1, 513)
    patterns, x = packing.solve(lengths, demand, 512)
    assert np.allclose(patterns.T @ x, demand) and (patterns @ lengths <= 512).all() and (x >= 0).all()
    assert x.sum() <= 1.01 * (lengths * demand).sum() / 512


def test_token_files(spark, docs, none, rows, tmp_path):
    got = sorted((r for r in tokenio.round_trip(docs).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    at = 0
    for r in got:
        ids = ids_of(next(x[1] for x in rows if x[0] == r.doc_id), 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenio.round_trip(none).count() == 0
    tokenio.write_tokens(docs, str(tmp_path / "t"))
    assert {r.doc_id for r in tokenio.read_tokens(spark, str(tmp_path / "t"), [8, 9]).collect()} == {8, 9}


def test_decontamination(spark, docs, none, rows):
    rng = random.Random(8)
    item = [f"w{rng.randint(0, 9999)}" for _ in range(30)]
    changed = list(item)
    for j in (7, 15, 23):
        changed[j] = "other"
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, "tiny item here", "x"), (3, None, "x"), (4, " ".join(item), "x"), (5, "five words stand right here", "x")], "item_id bigint, text string, doc_id string")
    more = [(100, "lead " + " ".join(item) + " tail", *[None] * 6), (101, "lead " + " ".join(changed).upper() + ".", *[None] * 6), (102, " ".join(item[:8]), *[None] * 6), (103, "oh five words stand right here!", *[None] * 6)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(both, bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (103, 5)}
    r = got[100, 1]
    assert more[0][1][r.start : r.end] == " ".join(item) and r.n_match == 30 and got[101, 1].n_match == 27
    kept = decontam.clean(both, bench)
    assert kept.columns == both.columns and kept.count() == both.count() - 3
    assert decontam.contaminated(none, bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_equals_brute_force(spark):
    """Any alignment that holds a window of one mask and verifies, tried at every shift of every item."""
    rng = random.Random(21)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(12)] + [[]]
    texts = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            x = list(items[rng.randrange(12)])
            x = x[rng.randrange(3) :]
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = "changed"
            w = w + x + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
        texts.append(w)

    want = brute.contaminated(texts, items)
    docs_ = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_match for r in decontam.contaminated(docs_, bench).collect()}
    assert got == want and len(want) > 20
    assert {r.doc_id for r in decontam.clean(docs_, bench).collect()} == set(range(80)) - {d for d, _ in want}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)
    items = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(15))) for i in range(6)], "item_id bigint, text string")
    texts = items.select(F.col("item_id").alias("doc_id"), "text")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(texts, items).collect()) == [(i, i) for i in range(6)]


def test_pii_base_spans():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("a.@-+0123 4%é()") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute.base_pii(t), t


def test_pii(docs, none, rows):
    got = {r.doc_id: r for r in pii.detect(docs).select("doc_id", pii.digest("spans").alias("d")).select("doc_id", "d.*").collect()}
    for i, t, *_ in rows:
        said = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in brute.base_pii(t))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert pii.detect(none).count() == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    texts = {r.doc_id: r for r in clean.collect()}
    assert "<EMAIL>" in texts[10].text and "4111" not in texts[10].text and texts[10].n_chars == len(texts[10].text)
    assert texts[5].text == rows[5][1] and texts[0].text is None


def test_pii_terms_that_disclose(spark):
    rng = random.Random(6)
    rows = [(i, f"{words(rng, 12)} vandermeer {rng.choice('abc')} writes from secret.person@corp.example.org about {words(rng, 12)}") for i in range(8)]
    rows += [(100 + i, words(rng, 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spans = {r.doc_id: {rows[r.doc_id][1][m.start : m.end] for m in r.spans if m.kind == 4} for r in pii.detect(df).where("doc_id < 8").collect()}
    assert all("vandermeer" in s and "alpha" not in s for s in spans.values())
    assert all(not r.spans for r in pii.detect(df).where("doc_id >= 100").collect())
    blocked = pii.span_column(df, "text", 0.8, 0.95)
    assert df.select(blocked.alias("s")).where(F.size("s") > 0).count() == 8


def test_pii_ratios_equal_brute_force(spark):
    """Spans of terms, from counts over all documents in plain Python."""
    rng = random.Random(13)
    rows = []
    for i in range(160):
        t = words(rng, 30)
        if i % 3 == 0:
            t = f"{words(rng, 9)} rare{i % 12} mail p{i % 6}@x{i % 2}.example.org or call +1 202 555 01{i % 4}0 now {words(rng, 9)}"
        rows.append((i, t))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {i: spans for (i, _), spans in zip(rows, brute.pii_spans([t for _, t in rows]), strict=True)}
    got = {r.doc_id: [(m.start, m.kind, m.end, m.level) for m in r.spans] for r in pii.detect(df).collect()}
    assert got == want and sum(k == 4 for s in want.values() for _, k, _, _ in s) > 20


def test_toxicity(spark, docs, none):
    rng = random.Random(9)
    bad = ["stupidhead", "moronic", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 40).split()
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), "x"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    y = spark.createDataFrame([*labels, (None, 1, "x"), (9999, 1, "x"), (5, None, "x")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(d, y)
    test = spark.createDataFrame([(1, "you stupidheads alpha beta"), (2, "alpha beta gamma of"), (3, None), (4, "x " * 3000)], "doc_id bigint, text string")
    s = {r.doc_id: r.s for r in test.select("doc_id", toxicity.score(test, model).alias("s")).collect()}
    assert s[1] > 0.5 > s[2] and all(0 <= v <= 1 for v in s.values())
    held = {r.doc_id: r.h for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held)
    assert docs.select(toxicity.score(docs, model)).count() == docs.count()
    clash = d.select("doc_id", "text", F.lit("x").alias("y"), F.lit(1).alias("_id"), F.lit(2).alias("t"), F.lit("z").alias("turn"))
    assert np.array_equal(toxicity.fit(clash, y).scores, model.scores)
    assert toxicity.fit(none, y.limit(0)).scores.any() == False  # noqa: E712


def test_toxicity_learns_from_the_end_of_a_long_text(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, 3000) + (" stupidhead" if i % 2 else " fine")) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    s = model.score(pa.array([f"{words(rng, 20)} stupidhead", words(rng, 20)]))
    assert s[0] > s[1]


PAGES = [
    ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<br><p>Four</article><footer>&copy; x</footer>", "A & B One two three. Four"),
    ("<article><p>kept<script>var t='</p>'</script> text</p><div id='comments'><p>reader words here</p></div></article><aside class=sidebar><p>other</p></aside>", "kept text"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Body.</p></main><form class=login><p>Sign in</p></form>", "Body."),
    ("<nav><ul><li><a href=x>Home</a></li></ul><button></nav><article><p>After an open button.</p><p>More of it.</p></article>", "After an open button. More of it."),
    ("<button><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head</h1><p>Between two buttons stand words.</p></article><button>two</button>", "Head Between two buttons stand words."),
    ("<article><p class=\"a\"\" id=x>A stray quote stays in its tag.</p><p title='it\"s'>Fine.</p></article>", "A stray quote stays in its tag. Fine."),
    ("", ""),
    (None, ""),
    ("just words", "just words"),
]


def test_html(spark):
    rows = spark.createDataFrame([(i, "u", p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract_pages(rows).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert htmltext.extract_pages(rows.limit(0)).count() == 0


def test_html_trees_on_unseen_layouts():
    rng = np.random.default_rng(12345)
    right = total = 0
    for _ in range(60):
        nodes, f, parent = htmltext.features(htmltext.made_page(rng))
        kept = htmltext.decode(htmltext.model().logit(f), parent)
        assert all(kept[p] or not k for k, p in zip(kept[1:], parent[1:], strict=True))
        right += sum(bool(k) == x.main for x, k in zip(nodes, kept, strict=True) if x.text)
        total += sum(1 for x in nodes if x.text)
    assert right >= 0.97 * total


def test_line_dedup(spark, docs, none):
    rng = random.Random(7)
    passage = "\n".join(words(rng, 12) + f" end{i}." for i in range(6)).replace("été", "ete")  # ASCII letters alone are lower-cased
    rows = [(1, words(rng, 20) + ".\n" + passage + "\n" + words(rng, 20)), (2, "Own line of text here.\n" + passage.upper().replace("\n", "\n ") + "\nlast"), (3, "short.\nshort."), (4, None), (None, passage), (5, "Tail first " + passage.replace("\n", " "))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    spans = dedup.duplicate_spans(d).collect()
    assert {s.doc_id for s in spans} == {2, 5} and all(s.kept_doc_id == 1 for s in spans)
    covered = sum(s.end - s.start for s in spans if s.doc_id == 2)
    assert covered > 0.7 * len(passage)
    left = {r.doc_id: r.text for r in dedup.remove_spans(d, dedup.duplicate_spans(d)).collect()}
    assert left[1] == rows[0][1] and left[2].startswith("Own line of text here.") and len(left[2]) < 60
    assert dedup.duplicate_spans(none).count() == 0 and dedup.duplicate_spans(docs).count() > 0


def test_line_dedup_passages_within_lines(spark):
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for i in range(20):  # neither sentence ends nor line ends at the passages' edges
        passage = own(51)
        again = passage.replace(" ", "\n", 1) if i % 2 else passage.upper()
        a, b = own(rng.randint(3, 90)), own(rng.randint(3, 90))
        rows += [(2 * i, f"{own(40)} {passage} {own(40)}"), (2 * i + 1, f"{a} {again} {b}")]
        want[2 * i + 1] = (len(a) + 1, len(a) + 1 + len(again), 2 * i, rows[-2][1].index(passage))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {s.doc_id: (s.start, s.end, s.kept_doc_id, s.kept_start) for s in dedup.duplicate_spans(d).collect()} == want


def test_line_dedup_clashes_and_ids_of_several_texts(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = own(60)
    texts = [f"{own(30)} {passage} {own(30)}", f"{own(10)} {passage} {own(50)}", f"{own(45)} {passage}"]
    d = spark.createDataFrame([(1, texts[0], 7, 7), (2, texts[1], 7, 7), (2, texts[2], 7, 7), (2, texts[1], 7, 7), (None, texts[0], 7, 7)], "doc_id bigint, text string, _id int, _cut int")
    spans = dedup.duplicate_spans(d).collect()
    assert len(spans) == 1 and spans[0].doc_id == 2 and spans[0].kept_doc_id == 1
    left = collections.Counter(r.text for r in dedup.remove_spans(d, dedup.duplicate_spans(d)).collect())
    cut = next(t for t in texts[1:] if t[spans[0].start : spans[0].end] == passage)
    whole = next(t for t in texts[1:] if t != cut)
    assert left == collections.Counter({texts[0]: 2, whole: 1 + (whole == texts[1]), cut.replace(passage, ""): 1 + (cut == texts[1])})


SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in SECRET.finditer(t) if len(m.group(2)) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(s)


def test_secrets(spark, docs, none, rows):
    rng = random.Random(2)
    parts = ["token", "=", ":", '"', " ", "secret", "API_KEY", "abcdefgh", "AKIA", "ABCDEFGHIJKLMN", "deadbeef" * 4, "é", "passwd", "x"]
    made = [(1000 + i, "".join(rng.choice(parts) for _ in range(12)), *[None] * 6) for i in range(200)]
    both = docs.union(spark.createDataFrame(made, SCHEMA))
    got = {r.doc_id: r for r in secretscan.digest(secretscan.detect(both)).collect()}
    for i, t, *_ in [*rows, *made]:
        said = ",".join(f"{secretscan.KINDS[k]}:{a}:{z}" for a, k, z in base_secrets(t))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
    text = rows[9][1]
    extra = [tuple(map(int, s.split(":")[1:])) for s in got[9].spans.split(",") if s.startswith("markov")]
    assert [text[a:z] for a, z in extra] == ["Zk3vQ9xT7pLw2Rb8Yc5Nd1Hf6Gj4Ms0"]
    assert secretscan.detect(none).count() == 0


def test_secret_models_tell_samples_apart(spark):
    table = secretscan.train(spark.createDataFrame([("ordinary internationalisation of words",)], "t string"))
    cells = F.array(*[F.lit(v) for row in table for v in row])
    score = lambda df: [r.s for r in df.select(secretscan.ratio(F.col("token"), cells).alias("s")).collect()]
    random_ = score(secretscan.random_strings(spark, 300))
    plain = score(secretscan.identifiers(spark, 300).where("length(token) >= 20"))
    assert np.mean(np.array(random_) > secretscan.THRESHOLD) > 0.97 and np.mean(np.array(plain) > secretscan.THRESHOLD) < 0.02


def test_secrets_with_slashes_and_short_ones(spark):
    secrets = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ8kTw3Vh5", "q7Rt9Xk2Lp4Zs8Vb1Nd6Hf3G/Jc5Wy0Tm9Qe2Ua", "Xq7Zr2Kp9Vt4Wj8B"]
    plain = ["src/main/service/config/reader.list", "internationalisation", "www.example.com/index/list", "get_user_name_from_config", "4465758382889437"]
    d = spark.createDataFrame([(i, f"seen: /{t}. here") for i, t in enumerate(secrets + plain)] + [(99, "internationalisation responsibilities characteristics " * 200)], "doc_id bigint, text string")
    got = {r.doc_id: [(m.start, m.value) for m in r.spans] for r in secretscan.detect(d).collect() if r.doc_id < 99}
    assert got == {i: [(7, t)] if t in secrets else [] for i, t in enumerate(secrets + plain)}
