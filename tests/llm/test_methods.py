"""The numbered operators' methods against brute force, and every registered query as it is registered."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stavework.llm import byte_bpe, common, decontaminate, lm, quality, registry, secrets, simhash, token_files, toxicity, urls

from test_small_cases import LOWER, SF, WORD, bpe, simhash_fp, tiktoken_encoding


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# op1


def best_overlap(text, item):
    best, span = None, min(decontaminate.MIN_OVERLAP, len(item))
    for start in range(1 - len(item), len(text)):
        low, high = max(0, start), min(len(text), start + len(item))
        same = [text[k] == item[k - start] for k in range(low, high)]
        good = [k for k in range(high - low - span + 1) if sum(same[k : k + span]) >= decontaminate.SIMILARITY * span]
        if good:
            hits = [k for k in range(good[0], good[-1] + span) if same[k]]
            if best is None or len(hits) > best[2]:
                best = low + hits[0], low + hits[-1] + 1, len(hits)
    return best


def hashed(words):
    return np.array([w * 0x9E3779B97F4A7C15 % (1 << 64) for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_every_overlap_is_found(seed, monkeypatch):
    """(text, item, span) on random texts with substituted words; small vocabularies make hot seeds."""
    if seed % 2:
        monkeypatch.setattr(decontaminate, "MANY_PAIRS", 2)
        monkeypatch.setattr(decontaminate, "MOST_PAIRS", 7)
    rng = random.Random(seed)
    for _ in range(60):
        v = rng.choice([3, 8, 40, 500])
        items = [[rng.randrange(1, v) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 20, 30]))] for _ in range(6)]
        texts = []
        for _ in range(5):
            item = [rng.randrange(1000, 2000) if rng.random() < 0.12 else w for w in rng.choice(items)]
            texts.append([rng.randrange(1, v) for _ in range(rng.randrange(30))] + item[rng.randrange(3) :] + [rng.randrange(1, v) for _ in range(rng.randrange(10))])
        block = decontaminate.Block([([i], hashed(w)) for i, w in enumerate(items)])
        got = {(i, k): tuple(o) for i, k, *o in block.leaks([hashed(t) for t in texts])}
        want = {(i, k): o for i, t in enumerate(texts) for k, w in enumerate(items) if (o := best_overlap(t, w))}
        assert got == want


def test_hot_seeds_take_no_pairs():
    block = decontaminate.Block([([1], np.full(5_000, 7, np.uint64))])
    assert list(block.leaks([np.full(50_000, 7, np.uint64)])) == [(0, 0, 0, 5_000, 5_000)]


def test_every_mask_ignores_a_word():
    assert all("0" in m for m in decontaminate.MASKS)


def test_op1(spark):
    items = {r.item_id: re.sub(r'[.,;:!?"()]', "", r.text.lower()).split() for r in rows_of(spark, "benchmark")}
    number = {w: i for i, w in enumerate(sorted({x for item in items.values() for x in item}))}
    index = {}
    for k, item in items.items():
        for w in item:
            index.setdefault(w, set()).add(k)
    want = {}
    for r in rows_of(spark, "documents"):
        text = re.sub(r'[.,;:!?"()]', "", (r.text or "").lower()).split()
        here = {}
        for w in text:
            for k in index.get(w, ()):
                here[k] = here.get(k, 0) + 1
        for k, n in here.items():
            if n >= 0.8 * min(10, len(items[k])) and (o := best_overlap([number.get(w, -1) for w in text], [number[w] for w in items[k]])):
                want[r.doc_id, k] = o
    got = registry.QUERIES["op1_benchmark_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id): (r.start, r.end, r.n_match) for r in got} == want and len(got) == len(want)


def test_clashing_columns_pass_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, item, 5, "x"), (2, None, 6, "y")], "doc_id long, text string, leaked_id int, words string")
    b = spark.createDataFrame([(1, item, 0), (2, "a b c d e f g h i j k l", 0)], "item_id long, text string, doc_id int")
    for block_words in (decontaminate.BLOCK_WORDS, 1):
        kept = decontaminate.drop_leaks(d, b, block_words)
        assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(2, None, 6, "y")]


# op2


def test_deep_branches_and_pooled_wildcards(spark):
    """A bad branch below the fourth level is rejected; many rare names are one branch with the sum of their labels."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        deep = rng.choice(["good", "bad"])
        rows.append((i, f"http://a.io/w/x/y/z/{deep}/{i}"))
        if i % 2:
            labels.append((i, deep == "good"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(1000, 1400):
        rows.append((i, f"http://a.io/user/{letters[i % 26]}{letters[i // 26 % 26]}/p"))
        if i % 4 == 0:
            labels.append((i, False))  # one label or two a name
    y = spark.createDataFrame(labels, "page_id long, good boolean")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), y).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        assert got[i].verdict == ("allow" if "good" in url else "block")
    assert {got[i].template for i in range(1000, 1400)} == {"/user/{*}/p"}
    assert {got[i].template for i in range(900)} == {"/w/x/y/z/good/{n}", "/w/x/y/z/bad/{n}"}


def test_similar_branches_are_merged(spark):
    rows = [(i, f"http://h.io/{'abcd'[i % 4]}/{i}") for i in range(800)]
    labels = spark.createDataFrame([(i, i % 4 < 2 or i % 16 == 3) for i in range(800)], "page_id long, good boolean")
    got = {r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()}
    assert got == {"/(a|b)/{n}", "/c/{n}", "/d/{n}"}


def test_urls_of_many_segments(spark):
    long = "http://h.io/" + "/".join("abc"[i % 3] for i in range(2000))
    rows = [(1, long), (2, long + "/x"), (3, "http://h.io"), (4, "http://h.io/?q"), (5, None), (5, None)]
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string")).count() == 6


def test_spread_join(spark, monkeypatch):
    big = spark.range(1000).selectExpr("id % 3 as k", "id as v", "id as salt")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, x string")
    want = sorted(map(tuple, big.join(small, ["k"]).collect()))
    for few in (100, 1):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        joined = common.spread_join(big, small, ["k"], big.v)
        assert joined.columns == ["k", "v", "salt", "x"] and sorted(map(tuple, joined.collect())) == want


# op3


def test_op3(spark):
    """All columns against plain counts; the score within what quantising and false positives may do, and better than the base on held-out texts."""
    docs = rows_of(spark, "documents")
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), "\n"] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c, c2 = {}, {}
    for i, t in tokens.items():
        if not held[i]:
            for a, b in zip(["\n", *t], t):
                c[b], c2[a, b] = c.get(b, 0) + 1, c2.get((a, b), 0) + 1
    n, v = sum(c.values()), len(c)

    def about(x):
        return float(lm.middle_counts(lm.levels(np.array([x])))[0]) if x else 0.0

    gain, n_held, near = 0.0, 0, []
    for r in registry.QUERIES["op3_lm_scoring"](spark, SF).collect():
        t = tokens[r.doc_id]
        base = sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(base)
        score = 0.0
        for a, b in zip(["\n", *t], t):
            p = (about(c.get(b, 0)) + 0.1) / (n + 0.1 * (v + 1))
            if a in c:
                p = lm.BIGRAM_WEIGHT * min(1.0, about(c2.get((a, b), 0)) / about(c[a])) + (1 - lm.BIGRAM_WEIGHT) * p
            score += np.log10(p)
        near.append(abs(r.score - score) <= 0.03 * abs(score))
        if held[r.doc_id]:
            gain, n_held = gain + r.score - r.base_score, n_held + len(t)
    assert np.mean(near) > 0.9
    assert gain / n_held > 0.15  # log10 a token


def test_pairs_of_rare_words_are_learnt(spark):
    """However large the rest of the corpus: a pair of two words that occur once scores better than the pair turned round."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(400))) for i in range(300)] + [(1000, "rareone raretwo")]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([(1, "rareone raretwo"), (2, "raretwo rareone")], "doc_id long, text string"), model).collect()}
    assert got[1] > got[2] + 2


def test_filter_is_filled_as_planned():
    rng = np.random.default_rng(1)
    for groups in (1, 5):
        every = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
        key, other = np.unique(every[lm.group_of(every, groups) == 0])[: 8_000], rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
        level = rng.integers(1, 9, len(key))
        data, bits = lm.filled(key, level, groups)
        assert np.bitwise_count(data).sum() < 0.4 * bits.sum()
        f = lm.Filter(groups, [0], [data], [bits])
        found = f.level(key)
        assert (found >= level).all() and (found == level).mean() > 0.97
        assert (f.level(other[lm.group_of(other, groups) == 0]) > 0).mean() < 0.03 and not f.level(other[lm.group_of(other, groups) != 0]).any()


# op4


def test_op4(spark):
    e, c = tiktoken_encoding(), byte_bpe.Codec(*bpe())
    texts = {r.doc_id: r.text or "" for r in rows_of(spark, "documents")}
    for r in registry.QUERIES["op4_byte_level_bpe"](spark, SF).collect():
        ids, text = e.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        if r.doc_id % 10 == 0:
            char_of = [k for k, ch in enumerate(text) for _ in ch.encode()]
            at, places = 0, ([], [])
            for i in ids:
                size = len(c.table[i])
                places[0].append(char_of[at])
                places[1].append(char_of[at + size - 1] + 1)
                at += size
            assert r.offsets_crc32 == zlib.crc32(np.array(places[0] + places[1], "<i8").tobytes())


# op6


def test_risk_and_slopes():
    """The risk from its definition, and the slopes from differences."""
    rng = np.random.default_rng(3)
    signs = set()
    for prior in (0.05, 0.4, 0.9):
        for shift in (-3, 0, 3):
            zp, zu = rng.normal(shift, 1, 7), rng.normal(0, 1, 9)
            loss = lambda z: np.log1p(np.exp(-z))
            positive, negative = prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()
            assert toxicity.risk(zp, zu, prior) == pytest.approx((positive, negative))
            signs.add(negative < 0)
            goal = lambda zp, zu: (lambda r: -r[1] if negative < 0 else r[0] + r[1])(toxicity.risk(zp, zu, prior))
            for z, g, at in ((zp, toxicity.slopes(zp, zu, prior)[0], 0), (zu, toxicity.slopes(zp, zu, prior)[1], 1)):
                for k in range(len(z)):
                    step = np.zeros(len(z))
                    step[k] = 1e-6
                    two = [goal(*((z + s, zu) if at == 0 else (zp, z + s))) for s in (step, -step)]
                    assert g[k] == pytest.approx((two[0] - two[1]) / 2e-6, abs=1e-6)
    assert signs == {True, False}


def test_op6(spark):
    """Held-out accuracy of the registered query on a larger table."""
    folder = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = registry.QUERIES["op6_toxicity"](spark, folder).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert sum(p for p, t in held if t) >= 0.5 * sum(t for _, t in held)


def test_repeated_rows_take_one_place_of_the_sample(spark):
    rows = [(1, "you idiot you")] * 3000 + [(i, f"nice day {i}") for i in range(2, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w, b = toxicity.fit(d, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.score(d, w, b).count() == len(rows)


# op7


def test_op7(spark):
    docs = rows_of(spark, "documents")
    fps = {r.doc_id: simhash_fp(r.text) for r in docs}
    group = dict.fromkeys(fps)
    for i in sorted(fps):
        if group[i] is None:
            group[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for j in fps:
                    if group[j] is None and (fps[x] ^ fps[j]).bit_count() <= 3:
                        group[j] = i
                        todo.append(j)
    got = registry.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", group[i]) for i in fps}


def test_hot_keys_are_split(spark):
    """Fingerprints that share a key and are within three bits still share one when it is split."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << x for x in rng.sample(range(64), 3)) for b in base]
    signed = [x - (1 << 64) if x >> 63 else x for x in base + near]
    split = simhash.split_hot(spark.createDataFrame([(7, x) for x in signed] + [(8, signed[0])], "key long, fp long"), 20).collect()
    keys = {}
    for r in split:
        keys.setdefault(r.fp, set()).add(r.key)
    assert all(keys[a] & keys[b] for a, b in zip(signed[:40], signed[40:])) and 8 in keys[signed[0]]
    assert max(sum(r.key == k for r in split) for k in {r.key for r in split}) <= 20


def test_rare_shingles_of_similar_sets_meet(spark):
    """Every two sets of the similarity are a candidate pair, and common passages alone make none."""
    rng = random.Random(5)
    common_part = [rng.getrandbits(62) for _ in range(60)]
    sets = []
    for _ in range(30):
        own = common_part + [rng.getrandbits(62) for _ in range(60)]
        sets += [own, [x if rng.random() > 0.08 else rng.getrandbits(62) for x in own]]
    rows = [(i, i, list(dict.fromkeys(x))) for i, x in enumerate(sets)]
    tokens = simhash.rare_first(spark.createDataFrame(rows, "set_id long, root long, h array<long>"), 0.8)
    got = {(r.a, r.b) for r in simhash.unconnected_pairs(tokens, 0.8).collect()}
    want = {(i, j) for i, _, a in rows for j, _, b in rows if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert want <= got and len(got) < 100


# op8


def test_coding_beats_a_plain_code(spark):
    """Fewer bits an id than deflated 16-bit ids, and than the entropy of single ids, on the ids of all documents of sf0.01."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect(), key=lambda r: r.doc_id)]
    ids = np.array([i for x in t.encode_batch(texts, add_special_tokens=False) for i in [*x.ids, 1]], np.uint32)
    data = token_files.pack([1], np.array([len(ids)]), ids)
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    bits = 8 * len(data) / len(ids)
    assert bits < -(p * np.log2(p)).sum() - 0.5 and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 1.4
    assert (token_files.unpack(data)[2] == ids).all()


def test_words_as_the_library_encodes_them():
    import public_tokenizers

    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    signs = [chr(c) for c in range(33, 256) if token_files.PLAIN(chr(c))]
    words = [a + b for a in signs for b in signs] + ["it's", "'STa", "don'T've", "x''S", "É'LL", "ÀÞß÷×ÿ", "漢字", "e\u0301", "İx", "ſ's"]
    want = [x.ids for x in e.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert all(e.of_plain(w) == x for w, x in zip(words, want) if token_files.PLAIN(w))
    import pyarrow as pa

    ids, n = e(pa.array([" ".join(words), None, "", " a\tb\n", *words]))
    whole = [[*x.ids, 1] for x in e.tokenizer.encode_batch([" ".join(words), "", "", " a\tb\n", *words], add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def test_op8(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r.doc_id: r for r in registry.QUERIES["op8_token_id_files"](spark, SF).collect()}, 0
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# op10


def test_op10(spark):
    texts = {r.doc_id: r.text or "" for r in rows_of(spark, "documents")}
    assign = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in registry.QUERIES["op10_secret_scans"](spark, SF).collect():
        text = texts[r.doc_id]
        kinds = [[("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8], [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16], [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]]
        base = [f"{k}:{a}:{b}" for k, a, b in sorted(sum(kinds, []), key=lambda s: (s[1], secrets.KINDS.index(s[0])))]
        assert [r.n_assign, r.n_access, r.n_hex] == list(map(len, kinds)) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_constants_against_a_walk():
    """Random chains of assignments: which literals reach a sensitive name, walked one step at a time."""
    rng = random.Random(8)
    for _ in range(200):
        names, lines, current = [f"n{i}" for i in range(6)] + ["password"], [], {}
        secret = set()
        for k in range(14):
            name, parts, reach = rng.choice(names), [], set()
            for _ in range(rng.choice([1, 1, 2])):
                if rng.random() < 0.5:
                    literal = f"Abcdef{k}{len(parts)}xyz9"
                    parts.append(f'"{literal}"')
                    reach.add(literal)
                else:
                    other = rng.choice(names)
                    parts.append(other)
                    reach |= current.get(other, set())
            lines.append(f"{name} = {' + '.join(parts)}")
            current[name] = reach
            if name == "password":
                secret |= reach
        text = "\n".join(lines)
        found = {text[a:b] for _, a, b in secrets.lexed_spans(text)}
        assert found == secret


def test_long_chains_take_linear_time():
    import time

    def took(n):
        chain = 'tok0 = "abcd1234efgh5678"\n' + "\n".join(f'tok{i} = tok{i - 1} + "x{i}abcdefg"' for i in range(1, n)) + f"\npassword = tok{n - 1}"
        began = time.perf_counter()
        assert len(secrets.lexed_spans(chain)) == n
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 16 * max(took(1000), 0.02)


# The pipeline


def test_pipeline_keeps_odd_rows_and_columns(spark, tmp_path):
    """Null and repeated ids, empty and null texts, repeated rows, clashing columns, and empty tables, through run()."""
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: ". ".join(" ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(90)) for _ in range(9)).capitalize() for _ in range(12)) + "."
    a, b, c, d = text(), text(), text(), text()
    leak = " ".join(f"bench{i}" for i in range(30)) + "."
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (5, c), (7, f"{text()}\n{leak}"), (8, ""), (9, None), (10, a)]
    names = "doc_id long, text string, leaked_id int, id_or_0 int, c2 int, __text_hash int, words int, n_chars int, root int"
    full = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, len(r[1] or ""), 6) for r in rows], names)
    for name, docs, bench in (("full", full, [(1, leak)]), ("no_documents", full.filter("false"), [(1, leak)]), ("no_benchmark", full, [])):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    want = [hashlib.sha256(t.encode()).hexdigest() for t in (a, b, c, d)]
    assert sorted(r.decoded_sha256 for r in got) == sorted(want) and sorted(r.doc_id or 0 for r in got) == [0, 5, 5, 10]
    assert corpus_pipeline.run(spark, f"{tmp_path}/no_documents").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/no_benchmark").count() == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, full, f"{tmp_path}/full").columns == full.columns and stage(spark, full, f"{tmp_path}/full").schema["n_chars"].dataType == full.schema["n_chars"].dataType


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_folder(Session)
