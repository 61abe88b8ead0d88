"""Each operator against a brute-force version, on odd, empty, null and repeated rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from quillmark.llm import decontaminate, html_extract, id_files, language, lm_score, near_copies, packing, quality, range_coder, simhash, token_count, url_filter, vp_tree
from quillmark.llm.components import connected_components
from quillmark.llm.html_blocks import blocks
from quillmark.llm.html_pages import MARK, labelled_pages
from quillmark.llm.pieces import PieceEncoder, encoder

DATA = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").limit(60)


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_windows_are_spliced_to_the_whole(request, name):
    enc, rng = encoder(request.getfixturevalue(name)), random.Random(3)
    parts = ["the", "tion", "é", " ", "  ", "\n", "日本", "12", "<|endoftext|>", "'s", "x", "　", "ABC"]
    widened = 0
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        ids, _, n = token_count.resync_ids(enc, text, rng.choice([5, 20, 64]), rng.choice([1, 4, 16]))
        widened += n
        assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert widened


def test_token_counts(clashing, byte_bpe):
    tok = Tokenizer.from_file(byte_bpe)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts(clashing)]
    for window in (16384, 64):
        got = token_count.count_tokens(clashing, byte_bpe, window=window, overlap=8)
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_count.count_tokens(clashing.limit(0), byte_bpe).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_url_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
    urls = ["http://NET/", "http://net", "https://EXAMPLE.net/en/", "https://m.example.net/en/3?x", "http://notexample.net/en/", "x://a.example.com/de/", "http://b.org/fr/q://z.net/", "nope", "", None, "://net/", "http://a..net/", "http://x.org/fr/#", "http://org?/fr/", "http://q.net/", "http://q.net/"]
    data = [(i, u, "x") for i, u in enumerate(urls)] + [(14, "http://q.net/", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, rule string")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([d[:2] for d in data], columns=["page_id", "url"]))
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(con.sql(url_filter.ORACLE).fetchall(), key=str)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_html_articles_are_found(spark):
    chain, wrong, total = html_extract.trained(), 0, 0
    for page in labelled_pages(100, 99):
        found = list(blocks(page, chain.weights.__contains__))
        states = chain.decode([sum(map(chain.weights.__getitem__, f)) for _, f in found])
        wrong += sum(bool(s) != (MARK in t) for (t, _), s in zip(found, states))
        total += len(found)
    assert wrong < 0.02 * total
    pages = spark.createDataFrame([(1, "u", "<nav><a href=x>m</a></nav><article><h1>A &amp; B</h1><p>c  <b>d</b>e<br><p>Some more.</article><footer>&copy; x</footer>", 1), (2, None, None, 1), (3, "", "", 1), (3, "", "", 1)], "page_id long, url string, html string, text int")
    assert rows(html_extract.extract_text(pages), "page_id", "text", "n_chars") == [(1, "A & B c de Some more.", 21), (2, "", 0), (3, "", 0), (3, "", 0)]


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(5)
    for _ in range(50):
        chain = html_extract.Chain({}, [[rng.uniform(-2, 2) for _ in "ab"] for _ in "ab"], [rng.uniform(-2, 2) for _ in "ab"])
        scores = [rng.uniform(-3, 3) for _ in range(6)]
        value = lambda s: chain.starts[s[0]] + sum(x * y for x, y in zip(s, scores)) + sum(chain.moves[a][b] for a, b in zip(s, s[1:]))  # noqa: E731,B023
        best = max(([n >> k & 1 for k in range(6)] for n in range(64)), key=value)
        assert chain.decode(scores) == best


@pytest.mark.parametrize("n", [0, 1, 15, 4096, 4097])
def test_range_coder_comes_back_and_notices_damage(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), np.full(n, 65535), np.tile([5, 9, 50256], n)[:n]):
        data = range_coder.encode_segment(ids.astype(np.uint32))
        assert range_coder.decode_segment(data).tolist() == ids.tolist()
    if n:
        with pytest.raises(range_coder.SegmentError):
            range_coder.decode_segment(data[:16] + bytes([data[16] ^ 1]) + data[17:])


def test_range_coder_takes_little_time_and_learns_from_all_blocks():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50257, (20_000, 4))
    ids = words[(rng.random(100_000) ** 3 * len(words)).astype(int)].ravel().astype(np.uint32)
    took = []
    for _ in range(3):
        began = time.process_time()
        data = range_coder.encode_segment(ids)
        back = range_coder.decode_segment(data)
        took.append(time.process_time() - began)
        assert (back == ids).all()
    assert len(data) < 1.5 * len(ids)  # words of 4 ids out of 20,000, met again in other blocks: 2.03 bytes an id with models for each block
    assert min(took) < 3e-6 * len(ids)  # on one machine 0.3 microseconds an id, and 6.2 with a step for each nibble


def test_range_coder_never_gives_wrong_ids():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 300, 700), np.zeros(70, int), np.array([]), np.array([5, 70_000, 5])):
        data = range_coder.encode_segment(ids.astype(np.uint32))
        for i in range(len(data)):
            for hurt in (data[:i], data[:i] + bytes([data[i] ^ 1 << i % 8]) + data[i + 1 :]):
                try:  # the last bits of a block may say nothing
                    assert range_coder.decode_segment(hurt).tolist() == ids.tolist()
                except range_coder.SegmentError:
                    pass


def test_shares_of_the_mixture_fill_the_range():
    rng = np.random.default_rng(6)
    for symbols in (1, 2, 5, 65_536):
        mix = range_coder._Mixer(symbols)
        for t in range(60):
            last, before = rng.integers(0, min(symbols, 3), (2, 40))
            mix.expect(last, before)
            for k in range(min(symbols, 5)):
                ids = np.full(40, k, np.int32)
                begin, width = mix.interval(ids)
                assert (begin == (end if k else 0)).all() and (width > 0).all()
                assert (mix.find(begin) == k).all() and (mix.find(begin + width - 1) == k).all()
                end = begin + width
            if symbols <= 5:
                assert (end == 1 << 26).all()
            ids = ((last + before + (rng.random(40) < 0.2)) % symbols).astype(np.int32)
            mix.interval(ids)
            mix.learn(ids, True)
            if t % 9 == 0:
                mix.count(ids)


def test_id_files(clashing, byte_bpe, spark, tmp_path):
    tok = Tokenizer.from_file(byte_bpe)
    lists = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in texts(clashing)]
    id_files.write_ids(clashing, byte_bpe, f"file://{tmp_path}/ids", segment_ids=500)
    got = sorted((tuple(r) for r in id_files.read_ids(spark, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    assert sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in lists) == sorted((str(i), n, c) for i, _, n, c in got)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[0] for r in got] == sorted((i for i, _ in lists), key=lambda i: (i is not None, i))


def test_cross_entropy_difference(spark):
    D = [(0, "a b a b a c"), (1, "a b a b"), (2, "x y z x y z"), (3, None), (4, " "), (1, "a b a b")]
    docs = spark.createDataFrame([(*d, 1) for d in D], "doc_id long, text string, target int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    words = lambda t: (t or "").split()

    def model(ds):
        uni, ctx, pair = Counter(), Counter(), Counter()
        for t in ds:
            for a, b in zip([None, *words(t)], words(t)):
                uni[b] += 1
                ctx[a] += 1
                pair[a, b] += 1
        return uni, ctx, pair

    everything, target = model(t for _, t in D), model(t for i, t in D if i == 1)
    size = len(everything[0]) + 2

    def loss(m, a, b):
        uni, ctx, pair = m
        taken = 0.7 * sum(n / ctx[a] for (h, _), n in pair.items() if h == a) if ctx[a] else 0
        return -np.log((0.7 * pair[a, b] / ctx[a] if ctx[a] else 0) + (1 - taken) * (uni[b] + 1) / (sum(uni.values()) + size))

    got = {r.doc_id: r for r in lm_score.score_documents(docs, labels).collect()}
    for i, t in D:
        steps = list(zip([None, *words(t)], words(t)))
        want = [np.mean([loss(m, a, b) for a, b in steps]) if steps else 0 for m in (target, everything)]
        assert got[i].n_words == len(steps) and np.allclose([got[i].target_loss, got[i].background_loss, got[i].score], [*want, want[0] - want[1]])
    assert got[1].score < got[2].score
    assert lm_score.score_documents(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("size", [8 << 20, 4096])
def test_language_models_keep_rare_words_and_pairs(spark, monkeypatch, size):
    """Beside 300,000 common words a pair and a word that occur once, also over many chunks and buckets."""
    monkeypatch.setattr(lm_score, "_CHUNK_BYTES", size)
    monkeypatch.setattr(lm_score, "_BUCKET_WORDS", 1 << 17)
    D = [(i, "a b " * 1500) for i in range(100)] + [(100, "b rare"), (101, "b a")]
    docs, labels = spark.createDataFrame(D, "doc_id long, text string"), spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, labels).collect()}
    assert sorted(got) == [i for i, _ in D]
    n, v = 300_004, 3 + 2
    first = 0.7 * 2 / 102 + 0.3 * 150_003 / (n + v)
    rare = 0.7 * 1 / (149_900 + 2) + 0.3 * 2 / (n + v)
    assert np.isclose(got[100].background_loss, -(np.log(first) + np.log(rare)) / 2)
    assert np.isclose(got[100].target_loss, -2 * np.log(0.7 + 0.3 * 2 / (2 + v)) / 2)


def test_language_models_take_every_target_document(spark):
    """Where all documents are good, however many, both models are one."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert max(abs(r.score) for r in lm_score.score_documents(docs, labels.unionByName(labels.limit(9))).collect()) < 1e-12


@pytest.mark.parametrize("bound", [100_000, 3])
def test_benchmark_windows(spark, clashing, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "One, TWO three"), (2, "one two three"), (10, "four five"), (3, None), (4, "!!"), (None, "日本 語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(100, f"x {long.upper()} y", None, None, 0, 0), (101, " ".join(long.split()[:12]), None, None, 0, 0)], "doc_id long, text string, lang string, source string, n_chars long, row long")
    docs = clashing.unionByName(more, allowMissingColumns=True)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(i, w[k : k + 13]) for i, t in items if (w := find(t)) for k in range(max(1, len(w) - 12))]
    want = []
    for i, t in texts(docs):
        w, hit, owners = find(t), set(), set()
        for owner, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    owners |= {owner} - {None}
        want.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    assert rows(decontaminate.leaks_by_document(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    assert decontaminate.leaks_by_document(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.leaks_by_document(docs.limit(0), bench).count() == 0


def _base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c, lines = Counter(zip(w, w[1:], w[2:])), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_scores(spark, clashing):
    labels = spark.createDataFrame([(16, 1), (14, 0)], "doc_id long, quality int")
    got = quality.judge(clashing, labels)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(((i, *_base(t)) for i, t in texts(clashing)), key=str)
    ratios = quality.log_ratios(clashing, labels)
    keys = [f"{a}" for a in ("one", "two")]
    hashed = {k: xxhash.xxh64_intdigest(k.encode(), 42) for k in keys}
    assert all(-20 < ratios[np.uint64(h).view(np.int64) % quality.BUCKETS] < 20 for h in hashed.values())
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got.collect())
    assert {r.score for r in quality.judge(clashing, labels.limit(0)).collect()} == {0.0}
    assert quality.keep_good(clashing, labels).columns == clashing.columns and quality.judge(clashing.limit(0), labels).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_of_odd_documents(clashing):
    got = language.identify_documents(clashing).collect()
    assert len(got) == clashing.count()
    letters = {i: bool(t) and any(c.isalpha() for c in t) for i, t in texts(clashing)}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got)
    assert language.keep_known(clashing).columns == clashing.columns
    assert language.identify_documents(clashing.limit(0)).count() == 0


def _components(pairs, reach):
    prints = []
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= reach:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    first = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        first[root(k)] += [i] if i is not None else []
    return [(i, f"{f:016x}", min(first[root(k)], default=None)) for k, (i, f) in enumerate(prints)], len({root(k) for k in range(len(up))})


@pytest.mark.parametrize("leaf", [2048, 8])
def test_near_duplicates(docs, clashing, monkeypatch, leaf):
    monkeypatch.setattr(simhash.close_links, "__defaults__", (2, leaf))
    both = docs.unionByName(clashing, allowMissingColumns=True)
    want, components = _components(texts(both), 2)
    assert rows(simhash.near_duplicates(both), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    kept = simhash.keep_first(both)
    assert kept.columns == both.columns and kept.count() == components
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    return bool(a & b) and 5 * len(a & b) >= 4 * len(a | b)


def near_copy_groups(pairs):
    """Of (key, text) pairs the keys of each group that similarities of 0.8 connect."""
    sets, group = [(k, _shingles(t)) for k, t in pairs], {k: k for k, _ in pairs}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if _alike(x, y) and group[a] != group[b]:
                gone, to = max(group[a], group[b]), min(group[a], group[b])
                group.update({k: to for k, g in group.items() if g == gone})
    return group


def _edited(rng, n):
    """Texts of 60 to 400 words, and copies of each with few or many words replaced."""
    made = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        made.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            made.append(" ".join(rng.choice(["x", w.upper()]) if rng.random() < rng.choice([0.01, 0.02, 0.05]) else w for w in words))
    return made


def test_shingle_sets_and_similarity():
    made = [*_edited(random.Random(5), 12), "a b", "A  b", "", " ", "a b c d e", "a b c d e f", "one " * 50]
    for x in made:
        assert len(near_copies.shingle_set(x.encode())) == len(_shingles(x))
        for y in made:
            assert near_copies.similar(near_copies.shingle_set(x.encode()), near_copies.shingle_set(y.encode())) == _alike(_shingles(x), _shingles(y))


def test_near_copies(spark, clashing):
    """Similar texts are linked, a shared passage links nothing, and the smallest id of each group stays."""
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(40))
    made = _edited(rng, 40) + [passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(40)) for _ in range(60)]
    made += [None, "", " ", "short", "Short", "x " * 9]
    table = list(enumerate(made))
    rng.shuffle(table)
    whole = near_copy_groups(table)
    docs = spark.createDataFrame([(k, k if k % 7 else None, t) for k, t in table], "row long, doc_id long, text string")
    gone = {r.row for r in near_copies.surplus(docs).collect()}
    members = defaultdict(list)
    for k, g in whole.items():
        members[g].append(k)
    assert gone == {k for m in members.values() for k in m} - {min(m, key=lambda k: (k % 7 == 0, k)) for m in members.values()}
    assert len(gone) > 20
    assert near_copies.similar_links(docs.select("row", "text").limit(0)).count() == 0
    kept = simhash.keep_first(clashing, similarity=0.8)
    assert kept.columns == clashing.columns and kept.count() <= simhash.keep_first(clashing).count()
    assert simhash.keep_first(clashing.limit(0), similarity=0.8).count() == 0


def test_one_large_group_of_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    copies = [" ".join("x" if k in (7 * i % 200, 11 * i % 200) else w for k, w in enumerate(words)) for i in range(1500)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(copies)], "row long, doc_id long, text string")
    assert {r.row for r in near_copies.surplus(docs).collect()} == set(range(1, 1500))


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    data = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    got = {(int(a), int(b)) for d, q in vp_tree.close_pairs(data, data, 3) for a, b in zip(d, q)}
    assert got == set(zip(*map(list, np.nonzero(vp_tree.hamming(data[:, None], data[None, :]) <= 3))))
    router = vp_tree.Router(data[::3], 16)
    own = dict(zip(*map(list, router.visits(data, 0))))
    visits = set(zip(*map(list, router.visits(data, 3))))
    assert len(own) == len(data) and all((a, own[b]) in visits for a, b in got)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 130)}}


def test_packing(docs, clashing, word_bpe):
    tok = Tokenizer.from_file(word_bpe)
    both = docs.unionByName(clashing.where("doc_id is null or doc_id <> 3").withColumn("doc_id", clashing.doc_id + 10**6), allowMissingColumns=True)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts(both)}
    got = packing.pack(both.repartition(3), word_bpe).toPandas()
    got["doc_id"] = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    for r in got.itertuples():
        x = ids[r.doc_id][r.start : r.start + r.length]
        assert 0 < len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, pieces in got.groupby("doc_id", dropna=False):
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == np.cumsum([0, *pieces.length])[:-1].tolist() and pieces.length.sum() == len(ids[i if pd.notna(i) else None])
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == np.cumsum([0, *pieces.length])[:-1].tolist() and pieces.length.sum() <= packing.SEQUENCE
    assert packing.pack(docs.limit(0), word_bpe).count() == 0


def test_plan_uses_no_more_than_there_is():
    rng = random.Random(2)
    counts = dict(Counter(rng.choice([700, 648, 1400, 1024, rng.randint(1, 2047)]) for _ in range(20000)))
    plan = packing.plan_sequences(counts)
    lengths = np.array([x for x, n in counts.items() for _ in range(n)])
    ranks = np.array([k for n in counts.values() for k in range(n)])
    placed, sequence, offset = plan.place(lengths, ranks)
    filled = pd.DataFrame({"s": sequence[placed], "o": offset[placed], "n": lengths[placed]}).sort_values(["s", "o"])
    assert (filled.groupby("s").n.sum() == packing.SEQUENCE).all() and filled.s.nunique() == plan.sequences and placed.mean() > 0.6
    assert (filled.groupby("s").n.transform(lambda n: n.cumsum() - n) == filled.o).all()


#: Pages written by hand, unlike those that the extractor is trained on, and their articles.
PAGES = {
    "<body><div><p>The council met on Monday to discuss the new bridge over the river.</p><p>It will open in spring, the mayor said.</p></div></body>": "The council met on Monday to discuss the new bridge over the river. It will open in spring, the mayor said.",
    "<table><tr><td><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></td><td><h1>Storm hits coast</h1><p>Heavy rain fell over the coast during the night and roads were closed.</p></td></tr></table>": "Storm hits coast Heavy rain fell over the coast during the night and roads were closed.",
    '<div id="wrap"><div class="top-nav"><ul><li><a href=/>Start</a></li></ul></div><div class="post-content"><h2>My trip</h2><p>We went up the hill at dawn. It was cold.</p><blockquote>What a view!</blockquote></div><div id="comments"><p>Nice post, thanks for it!</p></div><div class="site-footer">© 2021 Me</div></div>': "My trip We went up the hill at dawn. It was cold. What a view!",
    '<header><a href=/>Daily</a></header><nav><a href=/w>World</a><a href=/s>Sport</a></nav><main><article><h1>Team wins cup</h1><p>The team won the cup on Sunday.</p><aside class="related"><h3>More</h3><ul><li><a href=/x>Cup draw</a></li></ul></aside><p>Fans cheered.</p></article></main><footer><p>© Daily. All rights reserved.</p></footer>': "Team wins cup The team won the cup on Sunday. Fans cheered.",
    '<div class="cookie-consent"><p>We use cookies. <button>OK</button></p></div><div id="content"><p>Rivers carry sand to the sea over many years.</p></div><form action=/s><label>Search</label><input name=q></form>': "Rivers carry sand to the sea over many years.",
}


def test_articles_of_pages_from_elsewhere():
    chain = html_extract.trained()
    assert [chain.extract(page) for page in PAGES] == list(PAGES.values())


def test_extracted_text_is_that_of_the_best_labelling(spark):
    chain = html_extract.trained()
    for page in PAGES:
        found = list(blocks(page, chain.weights.__contains__))
        scores = [sum(chain.weights[f] for f in fs) for _, fs in found]
        value = lambda s: chain.starts[s[0]] + sum(x * y for x, y in zip(s, scores)) + sum(chain.moves[a][b] for a, b in zip(s, s[1:]))  # noqa: E731,B023
        best = max(([n >> k & 1 for k in range(len(found))] for n in range(1 << len(found))), key=value)
        assert chain.extract(page) == " ".join(t for (t, _), s in zip(found, best) if s)
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_faulty_markup_is_no_text():
    read = lambda page: [t for t, _ in blocks(page)]
    assert read("<script src=/js/app/>var leaked=1;</script>ok") == ["ok"]
    assert read('<p title="abc>text one</p>') == ["text one"] and read("<p class='a>b'>t</p>") == ["t"]
    assert read("a < b<p>c <d") == ["a < b", "c <d"] and read("<svg/>a<svg><path></svg>b<style>x</styles>y</style>") == ["ab"]


@pytest.mark.parametrize("part", ["<a ", "<a b=\"", "<", "<!--", "<ul><li>", "<a b=\">\" ", "</", "<b>", "<p>x"])
def test_long_faulty_pages_take_time_in_proportion(part):
    def took(n):
        page = part * (n // len(part)) + "</i><br>" * 1000
        begin = time.process_time()
        sum(1 for _ in blocks(page))
        return time.process_time() - begin

    assert took(1 << 18) < 16 * max(took(1 << 15), 0.05)


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs, ~language.held_out(docs.doc_id))
    foreign = ["Все счастливые семьи похожи друг на друга, каждая несчастлива по-своему.", "吾輩は猫である。名前はまだ無い。", "كان يا ما كان في قديم الزمان", "0123abcdef4567 " * 30, "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan"]
    asked = spark.createDataFrame([(t,) for t in foreign], "text string")
    assert all(r.found.rejected for r in asked.select(language.identified(asked, model).alias("found")).collect())
    kept = docs.select(language.identified(docs, model).alias("found")).where("not found.rejected").count()
    assert kept >= docs.where("text is not null").count() - 10
    tied = language.Model(["a", "b"], model.idf, np.stack([model.centroids[0]] * 2), np.array([0, 1]))
    assert tied.predict(["the same"])[0] == ["a"]


@pytest.mark.parametrize("kind", ["signs", "lines", "letters"])
def test_texts_without_spaces_are_spliced(byte_bpe, kind):
    rng = random.Random(1)
    text = {"signs": "".join(rng.choice("日本語のます。テキ、スト") for _ in range(60_000)), "lines": "\n".join("ab" * rng.randint(1, 4) for _ in range(9000)), "letters": "ab" * 20_000}[kind]
    enc = encoder(byte_bpe)
    ids, windows, _ = token_count.resync_ids(enc, text)
    assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert (windows > 2) == (kind != "letters")


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_pieces_give_the_ids_of_the_whole(request, name):
    path, rng = request.getfixturevalue(name), random.Random(4)
    enc = PieceEncoder(path)
    enc._memory.most = 300
    parts = ["the", "é", " ", "  ", "\n", "\n\n", "日本", "。", "12", "<|endoftext|>", "'s", "　", "ABC", ".", ",", "!", "…", "²", "́", "\xa0", "\x85", "\t", "’", "ß", "×", "Σ", "\r\n", "①", "한"]
    for k in range(10):
        some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, ""]
        ids, sizes = enc.encode(pa.array(some).slice(k))
        want = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in some[k:]], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want and enc.count(pa.array(some).slice(k)).tolist() == list(map(len, want))


def test_words_are_encoded_in_chains(byte_bpe):
    rng, enc = random.Random(8), PieceEncoder(byte_bpe)
    words = [" " + "".join(rng.choice("abcXYZ019'sé\u00ffßÀ.,!?-_(*|>#") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    ids, sizes = enc._chained(words)
    want = [e.ids for e in enc.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert all(map(enc._word.fullmatch, words)) and not any(map(enc._word.fullmatch, ["a", " ", " a b", " <", " a<", " ×", " 日", " a\n"]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    calls, encode = [], enc._encode
    enc._encode = lambda strings: calls.append(strings) or encode(strings)
    enc._bytes = enc._bytes + 1  # lengths that do not fit: the marks decide
    ids, sizes = enc._chained(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want and len(calls) == 2


def test_segments_join_slices():
    slices = [(pa.array([1, 2]), np.array([3, 4]), np.arange(7)), (pa.array([3, 4, None]), np.array([1, 9, 2]), np.arange(7, 19))]
    for most, want in ((100, [[1, 2, 3, 4, None]]), (8, [[1, 2, 3], [4], [None]]), (1, [[1], [2], [3], [4], [None]])):
        got = list(id_files._segments(iter(slices), most))
        assert [names.to_pylist() for names, _, _ in got] == want and np.concatenate([ids for _, _, ids in got]).tolist() == list(range(19))
        assert all(len(ids) == sizes.sum() for _, sizes, ids in got)


def test_quality_scores_by_brute_force(spark):
    """The hash of several columns is that of each with the hash of those before as seed."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c d"), (3, "x"), (4, None), (5, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    bucket = lambda *ws: __import__("functools").reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), ws, 42)
    place = lambda *ws: int(np.uint64(bucket(*ws)).view(np.int64)) % quality.BUCKETS
    grams = {r.doc_id: [place(*g) for w in [(r.text or "").split()] for g in [(x,) for x in w] + list(zip(w, w[1:]))] for r in docs.collect()}
    raw, good = Counter(x for g in grams.values() for x in g), Counter(x for i in (1, 5) for x in grams[i])
    n_raw, n_good = sum(raw.values()) + quality.BUCKETS, sum(good.values()) + quality.BUCKETS
    ratio = lambda x: np.log((good[x] + 1) / n_good) - np.log((raw[x] + 1) / n_raw)
    for r in quality.judge(docs, labels, threshold=-9).collect():
        want = np.mean([ratio(x) for x in grams[r.doc_id]]) if grams[r.doc_id] else 0
        assert abs(r.score - want) < 1e-4 and not r.kept and r.base_failed


def test_equal_rules_block(spark):
    rules = [("allow", "a.net", "/x"), ("block", "a.net", "/x"), ("allow", "net", "/x/y")]
    pages = spark.createDataFrame([(1, "h://b.a.net/x/y"), (2, "h://a.net/" + "x/" * 20_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.net/x", "block"), 2: ("a.net/x", "block")}


def test_ids_of_32_bits_and_files_of_nothing(spark, docs, byte_bpe):
    ids = np.array([0, 70_000, 2**32 - 1, 65_536, 5], np.uint32)
    assert range_coder.decode_segment(range_coder.encode_segment(ids)).tolist() == ids.tolist()
    assert id_files.through_files(docs.limit(0), byte_bpe).count() == 0
    got = id_files.through_files(docs.limit(5), byte_bpe).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.limit(5).collect())


def test_long_documents_are_packed_closely(spark, word_bpe):
    rows = [(None, "word " * 5000)] + [(i, "some text " * (i * 37 % 400)) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), word_bpe).toPandas()
    assert got[got.doc_id.isna()].length.sum() == 5001 and got.groupby(got.doc_id.fillna(-1)).length.sum().sum() == got.length.sum()
    assert got.sequence_id.nunique() * packing.SEQUENCE < 1.03 * got.length.sum()


def test_texts_longer_than_a_slice(spark, byte_bpe):
    text = "The cat, the dog. " * 300_000
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    tok = Tokenizer.from_file(byte_bpe)
    n = len(tok.encode(text[: 18 * 100], add_special_tokens=False).ids) * 3000
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, byte_bpe).collect()}
    assert abs(got[1] - n) <= 3000 and got[2] == 2
    bench = spark.createDataFrame([(1, "the dog the cat")], "item_id long, text string")
    leaks = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.leaks_by_document(docs, bench).collect()}
    assert leaks == {1: (1_200_000, 1_199_996, True), 2: (2, 0, False)}
