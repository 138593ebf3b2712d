"""What the findings of round 3 showed in the operators on training data."""

from __future__ import annotations

import random

import pyarrow as pa

from stavework.llm import simhash, token_files


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Sets that are near some of a large group only are connected before they would meet the whole group; the documents that stay are those of brute force."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(142)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(142), 3 if i % 6 == 1 else 1):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    seen = []

    def counted(tokens, similarity, of=simhash.unconnected_pairs):
        seen.append(of(tokens, similarity).count())
        return of(tokens, similarity)

    monkeypatch.setattr(simhash, "unconnected_pairs", counted)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id for r in kept} == set(root)

    assert sum(seen) < 3000  # 5,693 without that, 1,466 with it


def test_words_met_once_are_not_kept(monkeypatch):
    """Ids are the tokenizer's, whatever a worker keeps; words that come once leave nothing behind, and what is kept is bounded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path)
    monkeypatch.setattr(token_files, "CACHE_SIZE", 300)
    rng = random.Random(3)
    for k in range(6):
        texts = [None, "", *[" ".join(["The", "Été,", f"twice{k}", "日本", *[f"Once{rng.randrange(10**9)}." for _ in range(20)]]) for _ in range(10)]]
        texts += [" ".join([f"kept{k}x{i}"] * 2) for i in range(80)]
        ids, n = encoder(pa.array(texts, pa.string()))
        want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(encoder.number) <= 300 and not any(w.startswith("Once") for w in encoder.number)


def test_near_copies_leave_no_shuffle_files(spark, monkeypatch):
    """All jobs of the search remove their shuffles when they end; the session's setting is as before afterwards."""
    key, seen, plain = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], simhash.checkpointed
    before = spark.conf.get(key, None)
    monkeypatch.setattr(simhash, "checkpointed", lambda df: (seen.append(df.sparkSession.conf.get(key, None)), plain(df))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{j}" for j in range(30))) for i in range(9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, 5, 0.8).collect()) == [0, 1, 2]
    assert len(seen) > 3 and set(seen) == {"true"} and spark.conf.get(key, None) == before


def test_pieces_are_tokenized_in_lines():
    """All new pieces of a batch's words go to the model together, not one by one; words of no piece that is known, of all that are, and other scripts between them."""
    import public_tokenizers

    e = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["don't", "日本", "ÉTÉ,", "x1y22", "été", "it's", "\u00a0", "İx", "don't", "...''"]
    want = [x.ids for x in e.tokenizer.encode_batch(words, add_special_tokens=False)]
    model, lines = e.model, []
    e.model = type("Counted", (), {"encode": lambda self, text, **more: (lines.append(text), model.encode(text, **more))[1]})()
    for some in ([0, 1, 2, 3, 4], [0, 3], [1], [5, 6, 7, 8, 9], []):
        ids, size = e.encoded([words[i] for i in some])
        assert size.tolist() == [len(want[i]) for i in some] and ids.tolist() == [k for i in some for k in want[i]]
    assert len(lines) == 2
