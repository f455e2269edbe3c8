import collections
import hashlib
import random
import re

import pytest

from killgrid.llm import chat_format, exact_dedup, fingerprint, html_extract, language_id, mixing, near_dedup, packing, quality, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"
ROWS = [(1, "Aa bb cc dd ee", "en", "s", 1, 0), (2, "aA BB cc dd ee", "en", None, 1, 0), (2, "aA BB cc dd ee", "en", None, 1, 0), (3, None, None, "s", None, 0), (None, "", "en", "t", 0, 0), (5, "x " * 3000, "de", "t", 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.find_copies(docs).collect())
    assert ("1", "2", 3, False) in got and got.count(("2", "2", 3, True)) == 2
    assert ("None", "3", 2, False) in got and len(got) == 6
    assert exact_dedup.drop_copies(docs).count() == 3
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.find_copies(empty).count() == 0


def test_index_appends_only_what_is_new(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "X"), (8, "z")], "doc_id long, text string")
    exact_dedup.find_copies(a, index)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.find_copies(b, index).collect()}
    assert got == {9: (1, False), 8: (8, True)} and index.read().count() == 3


def test_chat_round_trip(spark):
    random.seed(0)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "a\nb", "é", "<\\s>", "[\\\\INST]"]
    for _ in range(500):
        t = "".join(random.choices(parts, k=random.randint(0, 6)))
        r = "".join(random.choices([*parts, "user"], k=2))
        assert chat_format.parse(chat_format.render(r, t)[0]) == (r, t)
        body = chat_format.render(r, t)[0][len(chat_format.START) : -len(chat_format.END) - 1]
        assert not any(c in body for c in chat_format.CONTROL)
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "assistant", "r</s>"), (1, 3, "user", "end"), (None, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_format.expand(turns)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].loss_chars == 5 and got[1].loss_sha256 == hashlib.sha256(b"r</s>").hexdigest()
    assert got[None].loss_chars == 0
    full = sorted((r.example, r.text, r.loss_start, r.loss_end) for r in chat_format.materialise(segments).where("conv_id = 1").collect())
    assert len(full) == 3 and sum(len(x[1]) for x in full) == got[1].formatted_chars
    assert [chat_format.unescape(t[a:b]) for _, t, a, b in full] == ["", "r</s>", ""]


def test_html():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, really, on this site, always.</p></div>
    <div id="content"><h2>Title &amp; more</h2><p>One,   two, three words that are long enough to count, surely.<p>Second &lt;b&gt; paragraph <b>bold</b>, with commas, and text.</div>
    <div class="comments"><p>Nice article, I liked it, really, very much so.</p></div><form><p>Sign up, please, now</p></form><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page) == "Title & more\n\nOne, two, three words that are long enough to count, surely.\n\nSecond <b> paragraph bold, with commas, and text."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p") == ""
    for cut in range(0, len(page), 7):
        html_extract.extract(page[:cut])


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=64).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 1
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0


def test_bin_completion_is_no_worse_than_best_fit():
    random.seed(1)
    for n in (1, 10, 300):
        h = collections.Counter(random.randint(1, 40) for _ in range(n))
        plan = packing.complete_bins(dict(h), 40)
        left = collections.Counter()
        for times, need in plan:
            assert sum(x * k for x, k in need.items()) <= 40
            for x, k in need.items():
                left[x] += times * k
        assert left == h
        bins = []  # best fit, longest first, one piece at a time
        for x in sorted(h.elements(), reverse=True):
            fits = [i for i, b in enumerate(bins) if b + x <= 40]
            if fits:
                bins[max(fits, key=lambda i: bins[i])] += x
            else:
                bins.append(x)
        assert -(-sum(h.elements()) // 40) <= sum(t for t, _ in plan) <= len(bins)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.rate_documents(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.quality <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.rate_documents(empty, labels.limit(0)).count() == 0


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.rate_documents(docs, labels).where("kept").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert good <= kept and len(bad & kept) <= 0.1 * len(bad)


def test_language(spark, docs, empty):
    rows = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count()
    got = language_id.predict(docs, {}).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == 6
    assert language_id.learn(empty) == {}


def shingle_set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_near_dedup(spark, docs, empty):
    random.seed(4)
    base = [random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 3) + str(random.randint(0, 99)) for _ in range(120)]
    rows = [(i, " ".join(w if random.random() > 0.004 * (i % 12) else f"e{random.random()}" for w in base)) for i in range(300)]
    rows += [(r[0] or 1000, r[1]) for r in ROWS]
    df = spark.createDataFrame([(1000 + i if i > 299 else k, t) for i, (k, t) in enumerate(rows)], "doc_id long, text string")
    sets = {r.doc_id: shingle_set(r.text, 3) for r in df.collect()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 85, 3).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in ids}
    assert near_dedup.near_duplicates(docs, 85, 3).count() == 6
    assert near_dedup.keep_one_each(docs).columns == docs.columns
    assert near_dedup.near_duplicates(empty, 85, 3).count() == 0


def brute_repeats(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"large": 2}, {"broadcast_bytes": 0}])
def test_suffix_dedup(spark, empty, options):
    random.seed(3)
    w = lambda n: "".join(random.choices("abcdefg ", k=n))
    shared = [w(450), w(900), "ab" * 500, "x" * 700, w(399)]
    rows = [(i, w(random.randint(0, 200)) + random.choice(shared) + w(random.randint(0, 300))) for i in range(40)] + [(50, None), (51, ""), (52, shared[1]), (52, shared[1]), (None, "é" * 250)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], 400)
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), n, h) for (i, _), (n, h) in zip(rows, want, strict=True))
    assert suffix_dedup.remove_repeats(empty, **options).count() == 0


def test_fingerprints(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.compare_with_next(docs, ranges=7).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = fingerprint.edited(text, following)
        a, b, c = (fingerprint.digests([x.encode()])[0] for x in (text, new, following))
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].fingerprint == a.tobytes().hex() and got[i].edited_fingerprint == b.tobytes().hex()
        assert abs(got[i].near_edited - fingerprint.likeness(a, b)) < 1e-9 and abs(got[i].near_next - fingerprint.likeness(a, c)) < 1e-9
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b")], "doc_id long, text string")
    assert fingerprint.compare_with_next(odd).count() == 4
    assert fingerprint.compare_with_next(empty).count() == 0


def test_mixing(spark, docs, empty):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (mixing.F.when(mixing.F.col("doc_id") % 3 == 0, "big").otherwise(mixing.F.col("source"))).alias("source"))
    tokens = {r.doc_id: len((r.text or "").split()) for r in own.collect()}
    rows = mixing.mixture(own, target=0.9).collect()
    assert {r.doc_id for r in rows} == set(tokens)
    total = sum(tokens[r.doc_id] for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(tokens[r.doc_id] for r in mine) / total - mine[0].weight) < 0.01
        assert mine[0].epochs <= mixing.MOST_REPEATS
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixture(empty).count() == 0
    half = mixing.mixture(own, target=0.9, budget=sum(tokens.values()) // 2).collect()
    # a quota is never exceeded, and short by less than one document of its source
    largest = collections.defaultdict(int)
    for r in own.select("doc_id", "source").collect():
        largest[r.source] = max(largest[r.source], tokens[r.doc_id])
    short = sum(tokens.values()) // 2 - sum(tokens[r.doc_id] for r in half)
    assert 0 <= short <= sum(largest.values())
