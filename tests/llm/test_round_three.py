"""Phrase mining, suffix-array dedup and whitening against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from stavework.llm import common, phrases, registry, secrets, suffixes, urls, whitening

from test_small_cases import LOWER, SF

# op11


def phrase_rows(docs, least=10, top=2000):
    """The contract, counted with plain dictionaries."""
    counts = {}
    for text, lang in docs:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        long_ = [p for p, a in c.items() if len(p) == 3 and a >= least]
        for p, a in c.items():
            if len(p) < 2 or a < least or len(p) == 2 and any(p in (t[:2], t[1:]) and 100 * c[t] >= 50 * a for t in long_):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_docs(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "ç", "the", "İ", "x y", "Of"]) if rng.random() < 0.6 else rng.choice("pqrstuv") * rng.randrange(1, 3)
    texts = ["".join(word() + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", "fr"), (" \t.", None), ("one two three " * 4000, "xx")]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    docs = phrase_docs(seed)
    got = phrases.collocations(spark.createDataFrame([(i, t, la, "w", 1) for i, (t, la) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrase_rows(docs)


def test_the_search_goes_on_until_it_is_settled(spark, monkeypatch):
    """Few phrases wanted and few nodes expanded at first: several rounds, and ties at the last place."""
    for name, value in (("TOP", 7), ("FIRST", 2), ("WIDER", 2)):
        monkeypatch.setattr(phrases, name, value)
    rounds, expanded = [], phrases.expanded
    monkeypatch.setattr(phrases, "expanded", lambda docs, nodes: rounds.append(1) or expanded(docs, nodes))
    docs = phrase_docs(3, 300)
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == phrase_rows(docs, top=7) and len(rounds) > 1


def test_nodes_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FEW_ROWS", 8)
    docs = phrase_docs(4)
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == phrase_rows(docs)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", "en")] * 9, "text string, lang string")).count() == 0


# op12


def removal(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
        out.append((len(b), int(gone.sum()), len(runs), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def repetitive(seed, length):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3 * length))) for _ in range(12)]
    texts = ["".join(rng.choice(base)[rng.randrange(length) :] for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    return [*texts, None, "", "a", "x" * (length - 1), "y" * length, "z" * (3 * length + 1), "ab" * 2 * length, texts[0], texts[0], "漢字" * length]


@pytest.mark.parametrize("length,anchor,first", [(24, None, None), (24, 8, 3), (25, 20, 6), (40, 11, 40), (10, 1, 1)])
def test_suffix_dedup(spark, length, anchor, first, monkeypatch):
    """From one to many rounds of doubling, and pieces shorter than the texts."""
    monkeypatch.setattr(suffixes, "PIECE", 50)
    texts = repetitive(length, length)
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "u", 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, u string, h1 int, spans string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, str(r.removed), bytes(r.kept)) for r in suffixes.without_repeats(df, length, anchor, first).collect())
    want = Counter((None if i == 3 else i // 2, n, m, k, str(runs), kept) for i, (n, m, k, runs, kept) in enumerate(removal(texts, length)))
    assert got == want


def test_suffix_dedup_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op12_suffix_array_dedup"](spark, SF).collect()}
    assert got == {d.doc_id: (n, m, k, hashlib.sha256(kept).hexdigest()) for d, (n, m, k, _, kept) in zip(docs, removal([d.text for d in docs], 200))}


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scratch_goes(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    suffixes.without_repeats(spark.createDataFrame([(1, "q" * 500)], "doc_id long, text string")).collect()
    assert not list(folder.glob("scratch-*")) and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


# op13


def whitened(rows):
    """(vec_id, component) to (n, deviation, whitened, explained), by numpy; vec_ids are unique."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    z = np.array([[float((n * a - b)) / n for a, b in zip(r, s)] for r in x])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    return {(i, k + 1): (n, sum((n * a - b) ** 2 for a, b in zip(x[j], s)), float(z[j] @ q[:, k] / np.sqrt(e[k])), float(e[k] / e.sum())) for j, (i, _) in enumerate(good) for k in range(min(8, len(e)))}


def same_up_to_sign(got, want, close):
    assert set(got) == set(want)
    signs = {}
    for key, (n, deviation, w, share) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - share) <= 1e-4 * share and r.identity_error <= 1e-4
        sign = signs.setdefault(key[1], np.sign(w * r.whitened) if abs(w) > 1e-3 else None) or np.sign(w * r.whitened)
        assert abs(sign * r.whitened - w) <= close


SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * np.linspace(1, 5, 12) + 3).tolist()) for i in range(300)]
    bad = [(1000, None), (1001, [None, *[0.0] * 11]), (1002, [float("nan"), *[0.0] * 11]), (1003, [float("inf"), *[0.0] * 11]), (1004, [])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "c") for r in rows + bad], SCHEMA).repartition(9))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same_up_to_sign({(r.vec_id, r.component): r for r in got.collect()}, whitened(rows + bad), 1e-8)


def test_whitening_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = registry.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    same_up_to_sign({(r.vec_id, r.component): r for r in got}, whitened(rows), 1e-8)


def test_whitening_of_degenerate_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == []
    one = make([(1, [1.0, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # two vectors, one repeated with a null id: one component alone has a variance; a vector of another length is dropped
    got = make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (4, [1.0])])
    assert len(got) == 9 and all((r.whitened is None) == (r.component > 1) and r.n == 3 for r in got)
    assert abs(sum(r.whitened**2 for r in got if r.component == 1) - 3) < 1e-9 and {round(r.explained, 9) for r in got if r.component == 1} == {1.0}


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**30 + 2**10 * i), float(-i)]) for i in range(5)]
    got = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)).collect()}
    assert got == {k: v[1] for k, v in whitened(rows).items()}


def test_rank_one_updates():
    """Equal eigenvalues, tiny and zero parts, vectors along an axis."""
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 9))
        d = np.sort(rng.choice([0, 0, 1, 1, 2, 5.0, 1e-9, 1e6], n) + (rng.random(n) * rng.choice([0, 1e-14, 1e-3, 1])))
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        z = q[:, 0] * 2 if rng.random() < 0.3 else rng.normal(size=n) * rng.choice([0, 1e-12, 1e-3, 1, 1e3])
        whole = q @ np.diag(d) @ q.T + np.outer(z, z)
        d2, q2 = whitening.rank_one(d, q, z)
        assert np.abs(q2 @ np.diag(d2) @ q2.T - whole).max() <= 1e-12 * max(np.abs(whole).max(), 1e-300)
        assert np.abs(q2.T @ q2 - np.eye(n)).max() < 1e-12 and (np.diff(d2) >= 0).all()


def test_spectra_add_up():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(500, 16)) * 10.0 ** rng.integers(-3, 4, 16)
    a, b = whitening.Spectrum(16), whitening.Spectrum(16)
    a.add(z[:200])
    b.add(z[200:210])
    b.add(z[210:])
    a.add_spectrum(b.d, b.q)
    assert np.abs(a.q @ np.diag(a.d) @ a.q.T - z.T @ z).max() <= 1e-11 * np.abs(z.T @ z).max()


# op10


@pytest.mark.parametrize("text", ["password=" + "(" * 200_000, "password=" + "x(" * 100_000, "password=" + "get(" * 100_000 + "'abcd1234efgh'", "a = [" * 100_000])
def test_open_brackets_take_linear_time(text):
    began = time.perf_counter()
    secrets.lexed_spans(text)
    assert time.perf_counter() - began < 8


def test_lookups_are_seen_within_brackets():
    key = "Xk9QpL0zzA1b"
    assert not secrets.lexed_spans(f'password = os.environ.get("{key}")') and not secrets.lexed_spans(f'password = (environ["{key}"])')
    assert secrets.lexed_spans(f'password = (environ["NAME"], ["{key}"])') or secrets.lexed_spans(f'password = wrap(("{key}"))')


def tree_by_loop(paths):
    """The purity of each path (a tuple of segments) with its (labelled, good), level by level; for nodes of few branches."""
    out = {}

    def purity(g, n, prior):
        return (g + urls.PRIOR * prior) / (n + urls.PRIOR)

    def apart(g, n, g2, n2):
        return (g * n2 - g2 * n) ** 2 * (n + n2) > urls.Z**2 * (g + g2) * (n + n2 - g - g2) * n * n2

    def walk(node, p):
        if len({rest for _, rest in node}) == 1:
            out.update({path: p for path, _ in node})
            return
        while all(rest for _, rest in node) and len({rest[0] for _, rest in node}) == 1:
            node = [(path, rest[1:]) for path, rest in node]
        branches = {}
        for path, rest in node:
            branches.setdefault(rest[0] if rest else "", []).append((path, rest[1:]))
        labels = {s: tuple(sum(paths[path][i] for path, _ in b) for i in (0, 1)) for s, b in branches.items()}
        nl, ng = (sum(x[i] for x in labels.values()) for i in (0, 1))
        last, groups = None, []
        for s in sorted(branches, key=lambda s: (labels[s][0] > 0, labels[s][1] / max(labels[s][0], 1), s)):
            l, g = labels[s]
            side = None if not l else 0 if not apart(g, l, ng, nl) else 1 if g * nl > ng * l else -1
            if last is None or last[0] != side or apart(g, l, *last[1]):
                groups.append([])
            groups[-1].append(s)
            last = side, (g, l)
        for group in groups:
            t = purity(sum(labels[s][1] for s in group), sum(labels[s][0] for s in group), p)
            out.update({path: t for s in group if not s for path, _ in branches[s]})
            if on := [x for s in group if s for x in branches[s]]:
                walk(on, t)

    l, g = (sum(x[i] for x in paths.values()) for i in (0, 1))
    walk([(path, path) for path in paths], purity(g, l, (g + 1) / (l + 2)))
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "pure", "few"])
def test_url_trees_against_a_loop(spark, kind):
    rng = random.Random(kind)
    paths = {}
    for _ in range(60):
        n = rng.randrange(5 if kind == "random" else 7)
        path = tuple("ab" * 4)[:n] if kind == "chain" else tuple(rng.choice("abc") for _ in range(n))
        labelled = {"random": rng.randrange(9), "chain": rng.randrange(40), "pure": 3, "few": 9 * (path[:2] == ("a", "b"))}[kind]
        good = 0 if kind == "pure" and path[:1] == ("b",) else labelled if kind in ("pure", "few") else rng.randrange(labelled + 1)
        paths[path] = (labelled, good)
    rows = [("h", list(path), l + 1, l, g) for path, (l, g) in paths.items()]
    with common.Scratch(spark) as scratch:
        got = urls.template_purities(spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, good long"), scratch).collect()
    want = tree_by_loop(paths)
    assert len(got) == len(paths)
    for r in got:
        assert r.purity == pytest.approx(want[tuple(r.shape)], rel=1e-12), r


def test_urls_of_one_to_three_hundred_levels(spark):
    """Traps of crawls: the rounds don't grow with the levels, so that it takes well under a minute."""
    rows = [(1000 * h + n, f"https://{host}/" + "/".join((first + "ab" * n)[:n])) for h, (host, first) in enumerate([("x.org", "a"), ("y.net", "b"), ("example.org", "e")]) for n in range(1, 301)]
    begun = time.time()
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 900 and all(r.verdict == "allow" for r in got if r.host != "y.net")
    assert time.time() - begun < 60
