"""Collocations of two and three words for each language, by best-first branch and bound.

One pass counts words and pairs. A pair is a node of the search: all longer phrases that begin with it have a score of
floor(1000000 * f(pair) / f(first word)) at most, because a phrase is no more frequent than its beginning and the rest of a
phrase no rarer than the phrase. Nodes are expanded best bound first: a pass over the texts counts all triples that hold
one of them, at its beginning or its end, which also tells whether the pair itself is dropped. A language is settled
when ``TOP`` phrases that stay score above every node that is left, so that no tie is open either.

A phrase's score is that of its lowest cut, floor(1000000 * a * a / (l * r)) with its own count a and those of the two parts,
as decimals of 38 digits. Words are strings throughout: no hash stands for one.

Cases: a null or empty text has no words; a null language is ``und``, together with rows that say so; repeated rows count
each time; an empty table gives no phrase; further columns of any name are ignored. Phrases of equal score go by count,
then by bytes. A language with fewer phrases than ``TOP`` gives all it has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, UPPER, checkpointed, shuffles_removed, spread_join, strings, table

MIN_COUNT, TOP, MAX_COVERED = 10, 2000, 50
#: Bytes of a language's texts that are counted together, and of all languages that a task holds.
CHUNK, HELD = 4_000_000, 8_000_000
#: Nodes are first expanded down to the score of the FIRST-th pair, then of WIDER times as many, and so on.
FIRST, WIDER = 2 * TOP, 4
#: Parts of a language's phrases whose best ones are found apart.
PARTS = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode() + b"\t" + SEPARATORS, UPPER.lower().encode() + b" " + b"\n" * len(SEPARATORS))
COUNTS = "lang string, phrase string, n long"


class Words:
    """The words of a folded text: their distinct values, a code for each word, and whether the next word is in the same piece."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        inside = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.values, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
        self.follows = piece[:-1] == piece[1:]
        self.pairs = self.codes[:-1] * len(self.values) + self.codes[1:]

    def text(self, *codes: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.values.take(pa.array(c)) for c in codes], " ")

    def words_and_pairs(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases with their counts; the empty phrase counts all words."""
        yield pa.array([""]), np.array([len(self.codes)])
        yield self.values, np.bincount(self.codes, minlength=len(self.values))
        found, n = np.unique(self.pairs[self.follows], return_counts=True)
        yield self.text(*np.divmod(found, len(self.values))), n

    def triples(self, nodes: list[str]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Triples that hold a node, with their counts."""
        ends = pc.split_pattern(pa.array(nodes, pa.string()), " ")
        first, last = (pc.index_in(pc.list_element(ends, k), self.values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        open_ = self.follows & np.isin(self.pairs, (first * len(self.values) + last)[(first >= 0) & (last >= 0)])
        at = np.flatnonzero((open_[:-1] | open_[1:]) & self.follows[:-1] & self.follows[1:])
        pairs, which = np.unique(self.pairs[at], return_inverse=True)
        found, n = np.unique(which * len(self.values) + self.codes[at + 2], return_counts=True)
        which, third = np.divmod(found, len(self.values))
        yield self.text(*np.divmod(pairs[which], len(self.values)), third), n


def counted(docs: DataFrame, count) -> DataFrame:
    """(lang, phrase, n): the sums over all texts of what count(lang, words) yields for the texts of a language that are counted together."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for phrases, n in count(lang, Words(b"\n".join(held.pop(lang)))):
                for k in range(0, len(n), 65_536):
                    part = phrases[k : k + 65_536]
                    yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(part)), part, pa.array(n[k : k + 65_536], pa.int64())], ["lang", "phrase", "n"])

        for b in batches:
            for lang, text in zip(strings(b.column(0)), strings(b.column(1)), strict=True):
                held.setdefault(lang, []).append(text.encode().translate(FOLD))
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= CHUNK:
                    yield from flush(lang)
            while sum(sizes.values()) >= HELD:
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from flush(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # chunks are counted already: a map of each task's phrases would take memory and join few rows
    return texts.mapInArrow(rows, COUNTS).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def expanded(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a) of the triples that hold one of the nodes and occur often enough; FEW_ROWS nodes are broadcast at a time."""
    spark, nodes = docs.sparkSession, nodes.select("lang", "phrase")
    blocks = -(-nodes.count() // (FEW_ROWS * 3 // 4)) or 1
    found = spark.createDataFrame([], "lang string, phrase string, a long")
    for k in range(blocks):
        block = nodes.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)) == k)
        open_: dict[str, list[str]] = {}
        for lang, phrase in block.toLocalIterator():
            open_.setdefault(lang, []).append(phrase)
        shared = spark.sparkContext.broadcast(open_)
        found = found.union(counted(docs.filter(F.coalesce("lang", F.lit("und")).isin(list(open_))) if len(open_) < 100 else docs, lambda lang, words, shared=shared: words.triples(shared.value.get(lang, []))).filter(F.col("n") >= MIN_COUNT).withColumnRenamed("n", "a"))
    return checkpointed(found.dropDuplicates(["lang", "phrase"]))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    return F.expr(f"(1000000 * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def first_of(df: DataFrame, order: list, most: int, rank: str) -> DataFrame:
    """The first so many rows of each language with their rank. Most rows may be of one language: it is dealt out first, and the first rows of each part meet."""
    parts = df.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn(rank, F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col(rank) <= most)
    return parts.drop("part").withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col(rank) <= most)


def search(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the ``TOP`` best phrases of each language that stay, with their rank; counts: of words and pairs."""
    words = counts.filter("phrase <> '' and instr(phrase, ' ') = 0").select("lang", F.col("phrase").alias("w"), F.col("n").alias("f"))
    pairs = counts.filter("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"))

    def with_count(df: DataFrame, of: DataFrame, key: Column, name: str) -> DataFrame:
        w, f = [c for c in of.columns if c != "lang"]
        return df.withColumn("key", key).join(of.select("lang", F.col(w).alias("key"), F.col(f).alias(name)), ["lang", "key"]).drop("key")

    nodes = with_count(with_count(pairs, words, F.substring_index("phrase", " ", 1), "l"), words, F.substring_index("phrase", " ", -1), "r")
    nodes = checkpointed(nodes.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"), F.expr("(1000000 * cast(a as decimal(15,0))) div l").alias("bound")))
    triples = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long")
    states, first = None, FIRST
    while True:
        best = first_of(nodes.select("lang", "phrase", "score"), [F.desc("score")], first, "k")
        cuts = best.groupBy("lang").agg(F.when(F.count("*") == first, F.min("score")).otherwise(F.lit(0)).alias("cut"))
        if states is not None:  # settled languages stay as they are
            cuts = cuts.join(states.select("lang", F.col("cut").alias("before"), "settled"), "lang").withColumn("cut", F.when(F.col("settled"), F.col("before")).otherwise(F.least("cut", "before")))
        else:
            cuts = cuts.withColumn("before", F.lit(None).cast("long"))
        cuts = checkpointed(cuts)
        here = spread_join(nodes, cuts, ["lang"], F.col("phrase"))  # most rows may be of one language
        triples = checkpointed(triples.union(expanded(docs, here.filter("bound >= cut and (before is null or bound < before)"))).dropDuplicates(["lang", "phrase"]))
        items = checkpointed(_items(here.filter("bound >= cut").drop("cut", "bound", "before", "settled"), triples, words, pairs, with_count))
        left = here.filter("bound < cut").groupBy("lang").agg(F.max("bound").alias("left"))
        bounded = cuts.select("lang", "cut").join(left, "lang", "left")
        above = spread_join(items, bounded, ["lang"], F.col("phrase")).filter("left is null or score > left").drop("cut")
        states = checkpointed(bounded.join(above.groupBy("lang").agg(F.count("*").alias("above")), "lang", "left").withColumn("settled", F.expr(f"left is null or coalesce(above, 0) >= {TOP}")))
        if not states.filter("not settled").limit(1).count():
            break
        first *= WIDER
    return first_of(above, [F.desc("score"), F.desc("a"), F.col("phrase")], TOP, "rank").withColumn("rank", F.col("rank").cast("long")).drop("left")


def _items(nodes: DataFrame, triples: DataFrame, words: DataFrame, pairs: DataFrame, with_count) -> DataFrame:
    """The expanded pairs that no triple covers, and all triples found."""
    inside = triples.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    stay = nodes.join(inside, ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {MAX_COVERED} * a").drop("most")
    parts = (words, F.substring_index("phrase", " ", 1), "l1"), (pairs, F.substring_index("phrase", " ", -2), "r1"), (pairs, F.substring_index("phrase", " ", 2), "l2"), (words, F.substring_index("phrase", " ", -1), "r2")
    for of, key, name in parts:
        triples = with_count(triples, of, key, name)
    triples = triples.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2"))
    low = F.col("s1") <= F.col("s2")
    pick = lambda name: F.when(low, F.col(f"{name}1")).otherwise(F.col(f"{name}2")).alias(name)
    return stay.select("lang", "phrase", "a", "l", "r", "score").union(triples.select("lang", "phrase", "a", pick("l"), pick("r"), pick("s").alias("score")))


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents (text, lang)."""
    docs = docs.select("text", "lang")
    with shuffles_removed(docs.sparkSession):
        counts = checkpointed(counted(docs, lambda lang, words: words.words_and_pairs()).filter((F.col("n") >= MIN_COUNT) | (F.col("phrase") == "")))
        found = search(docs, counts)
    return found.join(counts.filter("phrase = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, piece_text
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece_text FROM documents)
), listed AS (
  SELECT lang, piece, list_filter(regexp_split_to_array(piece_text, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), one AS (
  SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM listed
), words AS (
  SELECT lang, w AS phrase, count(*) AS f FROM one GROUP BY ALL
), totals AS (
  SELECT lang, count(*) AS n FROM one GROUP BY lang
), runs AS (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM one WINDOW p AS (PARTITION BY piece ORDER BY i)
), pairs AS (
  SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
), triples AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), covered AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY ALL
), scored AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f) AS score
  FROM pairs p JOIN words x ON x.lang = p.lang AND x.phrase = p.w1 JOIN words y ON y.lang = p.lang AND y.phrase = p.w2
  LEFT JOIN covered c ON c.lang = p.lang AND c.w1 = p.w1 AND c.w2 = p.w2 WHERE p.f >= 10 AND (c.most IS NULL OR 100 * c.most < 50 * p.f)
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, y.f AS r2, 1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * q.f) AS s1, 1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * y.f) AS s2
    FROM triples t JOIN words x ON x.lang = t.lang AND x.phrase = t.w1 JOIN words y ON y.lang = t.lang AND y.phrase = t.w3
    JOIN pairs p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN pairs q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3
  )
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_phrase_mining": query}
ORACLES = {"op11_phrase_mining": SQL}
